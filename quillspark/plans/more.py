"""Queries of code search, degraded retrieval and the lifetime of sessions, accounts and versions, each with SQL that gives its rows."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import code, decisions, dml, evaluation, fusion, graph, lifecycle, models, search, sessions
from ..operators.collection import VectorCollection
from ..operators.ingest import KEY, DocumentIndex
from ..operators.stored import StoredIndex
from ..operators.vector_cache import VectorCache
from ..sources.files import table
from ..sources.scratch import delete, drop, fresh_dir, spread, stored
from ..sources.snapshots import Snapshots
from . import queries as Q
from .oracles import _CODE, _EDGES, _FS, _HOME, _LISTS, _PEN, _STRIP, _V, ORACLES, _hits

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# ---- stored index


@_query(ORACLES["bm25_topk"])
def bm25_stored(spark: SparkSession, d: str) -> DataFrame:
    """As bm25_topk, by an index that is written first; where its manifest's corpus cannot be read, from the documents. The second call to ensure builds nothing."""
    root = fresh_dir(spark, "bm25")
    index = StoredIndex(Snapshots(spark, root), "doc_id")
    docs = Q._documents(spark, d).select("doc_id", "text")

    def signature() -> str:
        rows = docs.select(F.xxhash64("doc_id", "text").cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.sum("h").alias("s")).first()
        return f"{rows['n']}:{rows['s']}"

    corpora = [lambda: table(spark, d, "manifest_documents"), lambda: docs]
    if index.ensure(corpora, signature) != index.ensure(corpora, signature):
        raise RuntimeError("an index was built twice")
    found = index.search(table(spark, d, "benchmark").select("item_id", "text"), "item_id", Q.ASKED)
    delete(spark, root)
    return found.select("item_id", "rank", "doc_id", F.round("score", 6).alias("score"))


# ---- incremental ingest

_PIECE = 800
#: Texts of three days: some come later, some change, some go.
_DAYS = ["doc_id % 10 <> 2", "doc_id % 10 <> 0", "doc_id % 10 <> 0"]
_TEXTS = ["text", "text || CASE WHEN doc_id % 10 = 1 THEN '+' ELSE '' END", "text || CASE WHEN doc_id % 10 = 1 THEN '+' WHEN doc_id % 10 = 3 THEN '!' ELSE '' END"]
_DAY = ", ".join(f"d{i} AS (SELECT doc_id, t, CAST(ceil(length(t) / {_PIECE}.0) AS BIGINT) AS n FROM (SELECT doc_id, {t} AS t FROM documents WHERE {w}) x)" for i, (w, t) in enumerate(zip(_DAYS, _TEXTS, strict=True), 1))
_PIECES = " UNION ".join(f"SELECT {i} AS step, substr(t, CAST(k * {_PIECE} + 1 AS BIGINT), {_PIECE}) AS p FROM d{i}, unnest(generate_series(0, n - 1)) u(k)" for i in (1, 2, 3))


def _step(i: int, a: str, b: str) -> str:
    n = lambda what, where: f"(SELECT {what} FROM {a} a FULL JOIN {b} b ON a.doc_id = b.doc_id WHERE {where})"
    same, other = "a.t = b.t", "a.t <> b.t"
    docs = {"added": "a.doc_id IS NULL", "modified": other, "deleted": "b.doc_id IS NULL", "unchanged": same}
    counts = ", ".join(f"{n('count(*)', w)} AS {c}" for c, w in docs.items())
    total = lambda w: n("CAST(coalesce(sum(b.n), 0) AS BIGINT)", w)
    return f"SELECT {i} AS step, {counts}, {total(same)} AS copied_chunks, {total('a.doc_id IS NULL OR ' + other)} AS embedded_chunks, {total('b.doc_id IS NOT NULL')} AS total_chunks, {str(i == 4).lower()} AS skipped, (SELECT count(DISTINCT p) FROM pieces WHERE step <= {min(i, 3)}) AS vectors, {min(i, 2)} AS versions"


def _skipped() -> str:
    return _step(4, "d3", "d3").replace("(SELECT CAST(coalesce(sum(b.n), 0) AS BIGINT) FROM d3 a FULL JOIN d3 b ON a.doc_id = b.doc_id WHERE a.t = b.t) AS copied_chunks", "CAST(0 AS BIGINT) AS copied_chunks")


def _toy_model():
    """A stand-in for a caller's model: a few numbers from each text's checksum."""
    return lambda texts, **_: [[float(c >> k & 255) + 1 for k in (0, 8, 16, 24)] for c in (zlib.crc32(t.encode()) for t in texts)]


@_query(f"WITH {_DAY}, none AS (SELECT * FROM d1 WHERE false), pieces AS ({_PIECES}) " + " UNION ALL ".join([_step(1, "none", "d1"), _step(2, "d1", "d2"), _step(3, "d2", "d3"), _skipped()]))
def ingest_steps(spark: SparkSession, d: str) -> DataFrame:
    """Three states of the documents taken in one after the other, the last one twice: what each ingest found, shared and encoded."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    root = fresh_dir(spark, "ingest")
    cache = VectorCache(spark, f"{root}/vectors")
    piece = F.transform(F.sequence(F.lit(1), F.ceil(F.length("text") / _PIECE).cast("int")), lambda i: F.struct((i - 1).alias("chunk_id"), F.substring("text", (i - 1) * _PIECE + 1, F.lit(_PIECE)).alias("text")))
    cut = lambda t: t.filter("length(text) > 0").select(KEY, F.explode(piece).alias("c")).select(KEY, "c.*")
    index = DocumentIndex(Snapshots(spark, f"{root}/index"), cut, lambda c: cache.encoded(c, "text", _toy_model, "checksum"), {"piece": _PIECE}, retain=2)
    rows = []
    for i, (there, text) in enumerate(zip([*_DAYS, _DAYS[-1]], [*_TEXTS, _TEXTS[-1]], strict=True), 1):
        now = docs.filter(there).select(F.col("doc_id").alias(KEY), F.expr(text).alias("text"))
        digest = F.sha2("text", 256)
        records = now.select(KEY, F.concat(F.lit("docs/"), KEY).alias("key"), digest.alias("version_id"), digest.alias("etag"), F.octet_length("text").alias("size"), digest.alias("content_hash"))
        known = now.filter(F.col(KEY).isNotNull())  # at first all are new, so that none need be looked up
        r = index.ingest(records, (lambda new, known=known: known) if i == 1 else lambda new, now=now: now.join(new.select(KEY), KEY, "left_semi"))
        rows.append((i, r.added, r.modified, r.deleted, r.unchanged, r.copied_chunks, r.embedded_chunks, r.total_chunks, r.skipped, cache.size("checksum"), len(index.store.versions())))
    delete(spark, root)
    return spark.createDataFrame(rows, "step int, added long, modified long, deleted long, unchanged long, copied_chunks long, embedded_chunks long, total_chunks long, skipped boolean, vectors long, versions int")


# ---- stored vectors


def _collection(spark: SparkSession, d: str) -> VectorCollection:
    made = VectorCollection(Snapshots(spark, fresh_dir(spark, "vectors")))
    made.ensure(table(spark, d, "embeddings"), 64)
    return made


def _of_collection(made: VectorCollection, rows: DataFrame) -> DataFrame:
    out = stored(rows)
    delete(made.store.spark, made.store.root)
    return out


@_query(ORACLES["vector_topk"])
def collection_topk(spark: SparkSession, d: str) -> DataFrame:
    """As vector_topk, from a stored collection whose cells are skipped where they can hold nothing."""
    made = _collection(spark, d)
    return _of_collection(made, made.search(Q._asked(Q._vectors(spark, d)), Q.ASKED))


@_query(ORACLES["vector_filtered"])
def collection_filtered(spark: SparkSession, d: str) -> DataFrame:
    made = _collection(spark, d)
    return _of_collection(made, made.search(Q._asked(Q._vectors(spark, d)), Q.ASKED, F.col("label").isin(1, 3, 5)))


@_query("SELECT vec_id, label FROM embeddings WHERE vec_id > 100 AND embedding IS NOT NULL ORDER BY vec_id LIMIT 256")
def collection_scroll(spark: SparkSession, d: str) -> DataFrame:
    """One page of a scroll by id, without vectors."""
    made = _collection(spark, d)
    return _of_collection(made, made.scroll(100, 256))


# ---- routes by all steps


def _counting_model():
    """A stand-in for a caller's model: three counts of each text."""
    return lambda texts, **_: [[float(len(t) % 97 + 1), float(t.count("e")), float(t.count(" "))] for t in texts]


_COUNTS = "list_transform([length({0}) % 97 + 1, length({0}) - length(replace({0}, 'e', '')), length({0}) - length(replace({0}, ' ', ''))], lambda x: CAST(x AS DOUBLE))"
_UNIT = "list_transform(x, lambda y: y / sqrt(list_inner_product(x, x)))"


@_query(f"""WITH k AS ({ORACLES['keyword_route']}), t AS (SELECT conv_id, turn, {_COUNTS.format('text')} AS x FROM conversations WHERE role = 'user'),
    o AS (SELECT conv_id, turn, {_UNIT} AS v FROM t JOIN k USING (conv_id, turn) WHERE route = 'fallback_rag'),
    b AS (SELECT item_id % 2 AS kind, {_COUNTS.format('text')} AS x FROM benchmark), an AS (SELECT kind, {_UNIT} AS v FROM b),
    s AS (SELECT conv_id, turn, max(CASE WHEN kind = 0 THEN round(list_inner_product(o.v, an.v), 6) END) AS r, max(CASE WHEN kind = 1 THEN round(list_inner_product(o.v, an.v), 6) END) AS d FROM o CROSS JOIN an GROUP BY conv_id, turn),
    z AS (SELECT k.conv_id, k.turn, CASE WHEN k.route <> 'fallback_rag' THEN k.route WHEN r >= 0.9 AND round(r - d, 6) >= 0.0001 THEN 'embedding_rag' WHEN d >= 0.9 AND round(r - d, 6) <= -0.0001 THEN 'embedding_direct'
          WHEN k.turn % 3 = 0 THEN 'llm_rag' WHEN k.turn % 3 = 1 THEN 'llm_direct' ELSE 'fallback_rag' END AS route FROM k LEFT JOIN s USING (conv_id, turn))
    SELECT conv_id, turn, route, route NOT LIKE '%direct' AS use_rag FROM z""")
def routed_questions(spark: SparkSession, d: str) -> DataFrame:
    """Users' turns by phrases, state, anchors (passages of the benchmark) and a model's replies, with vectors from a table of those that were encoded."""
    cache = VectorCache(spark, fresh_dir(spark, "anchors"))
    rows = table(spark, d, "conversations").filter("role = 'user'")
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")).isNotNull()
    reply = F.when(F.col("turn") % 3 == 0, '{"use_rag": true}').when(F.col("turn") % 3 == 1, '<answer>{"use_rag": false}</answer>')
    asked = rows.select(F.struct("conv_id", "turn").alias("key"), F.col("text").alias("question"), "text", before.alias("used_rag"), before.alias("had_contexts"), reply.alias("reply"))
    asked = asked.withColumn("key", F.concat_ws(":", "key.conv_id", "key.turn"))
    anchors = table(spark, d, "benchmark").select(F.when(F.col("item_id") % 2 == 0, "rag").otherwise("direct").alias("kind"), "text")
    found = stored(decisions.decided(asked, "key", anchors, cache, _counting_model, "counts", Q.DOMAIN, 0.9, 0.9, 0.0001))
    delete(spark, cache.root)
    part = lambda i: F.get(F.split("key", ":"), F.lit(i)).cast("long")
    return found.select(part(0).alias("conv_id"), part(1).alias("turn"), "route", "use_rag")


# ---- sessions, accounts and counts that changes touch


@_query(ORACLES["last_user_two"].replace("SELECT conv_id, CASE WHEN length(q) <= 300", "SELECT conv_id, CASE WHEN length(q) <= 3000").replace("right(q, 300)", "right(q, 3000)").replace(
    "string_agg(content, chr(10) ORDER BY turn)", "string_agg(content, chr(10) ORDER BY turn) || chr(10) || 'and ' || min(conv_id) || ' then?'"))
def search_queries(spark: SparkSession, d: str) -> DataFrame:
    """The last two messages of each user who has any, with a question after them."""
    h = Q._history(spark, d)
    asked = h.filter("role = 'user'").select("conv_id").distinct().withColumn("question", F.concat(F.lit(" and "), F.col("conv_id").cast("string"), F.lit(" then? ")))
    return sessions.search_queries(h, asked)


@_query(f"SELECT regexp_replace(route, '_[^_]*$', '') AS prefix, count(*) AS n FROM ({ORACLES['keyword_route']}) k GROUP BY 1")
def route_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.route_prefixes(Q.keyword_route(spark, d), [])


@_query("""SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 AND c_mktsegment = 'BUILDING' THEN CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal + 10 END ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 7 <> 0
    UNION ALL SELECT c_custkey, 'new', c_acctbal + 10, 'ADDED' FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 3 = 0""")
def upsert_conditional(spark: SparkSession, d: str) -> DataFrame:
    """Balances change where the segment allows it; what was below zero becomes zero; unknown customers are added."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    rows = c.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("c_name"), (F.col("c_acctbal") + 10).alias("c_acctbal"), F.lit("ADDED").alias("c_mktsegment"))
    balance = F.when(F.col("c_acctbal") < 0, 0.0).otherwise(F.col("new.c_acctbal"))
    return dml.upsert_where(c.filter("c_custkey % 7 <> 0"), rows, ["c_custkey"], {"c_acctbal": balance}, F.col("c_mktsegment") == "BUILDING")


@_query("""WITH s AS (SELECT o_orderkey AS session_id, o_custkey AS user_id, o_orderpriority AS title, o_orderdate AS created_at, o_orderdate AS updated_at FROM orders WHERE o_orderkey % 3 <> 0
    UNION ALL SELECT o_orderkey, min(l_suppkey), 'New chat', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-01' FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 3 = 0 GROUP BY o_orderkey)
    SELECT session_id, user_id, title, CAST(created_at AS VARCHAR) AS created_at FROM s WHERE (session_id, user_id) IN (SELECT (l_orderkey, l_suppkey) FROM lineitem)""")
def session_create_get(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers open sessions for their orders where there is none, then ask for all orders of theirs."""
    o = table(spark, d, "orders").filter("o_orderkey % 3 <> 0")
    s = o.select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"))
    asked = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_suppkey").alias("user_id"))
    own = lifecycle.owned(lifecycle.created(s, asked, F.lit("2024-01-01").cast("timestamp_ntz")), asked)
    return own.select("session_id", "user_id", "title", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@_query("SELECT CAST(row_number() OVER (ORDER BY lower(r), r) AS INTEGER) AS place, r AS repository FROM (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END AS r FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 5 <> 0) x")
def repositories_below(spark: SparkSession, d: str) -> DataFrame:
    """Folders below a root that hold code, hidden ones and those of texts aside."""
    name = F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source"))
    path = F.concat(name, F.when(F.col("doc_id") % 11 == 0, "/.cache/").otherwise("/src/"), F.col("doc_id").cast("string"))
    return lifecycle.discovered(table(spark, d, "documents").select(path.alias("path"), F.when(F.col("doc_id") % 5 != 0, "python").alias("language")), "root")


@_query("""WITH c AS (SELECT l_orderkey AS query_id, l_partkey AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS rank, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
    s AS (SELECT *, (id * 37 + rank) % 11 / 10.0 AS score FROM c),
    z AS (SELECT query_id, id, rank, score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 4 THEN -score END, (rank - 1) // 4, -rank) AS new_rank FROM s)
    SELECT query_id, id, CAST(new_rank AS INTEGER) AS new_rank, CAST(score AS DOUBLE) AS rerank_score FROM z WHERE new_rank <= 3""")
def rerank_replies(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as candidates, four to a call; each reply names them from the last to the first."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("id"), F.row_number().over(w).alias("rank"))
    result = F.struct(((F.col("rank") - 1) % 4).alias("index"), ((F.col("id") * 37 + F.col("rank")) % 11 / 10.0).cast("double").alias("relevance_score"))
    batch = F.floor((F.col("rank") - 1) / 4).cast("int").alias("batch")
    replies = c.groupBy("query_id", batch).agg(F.sort_array(F.collect_list(result), asc=False).alias("results"))
    return fusion.from_replies(c, replies, 3, 4).select("query_id", "id", "new_rank", "rerank_score")


# ---- walks

_WALK = 12


def _level(n: int) -> str:
    """The nodes that level n adds: from each node of the level before its four first neighbours, those that are new, within the budget."""
    before = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(n))
    return f"""
        r{n} AS (SELECT set_id, place AS f, neighbour, row_number() OVER (PARTITION BY set_id, place ORDER BY CASE WHEN nb.path = home THEN 0 ELSE 1 END, degree DESC, label, neighbour) AS r
                 FROM l{n - 1} JOIN nb ON nb.id = l{n - 1}.id JOIN (SELECT s_suppkey AS h, s_nationkey AS home FROM supplier) y ON h = set_id),
        c{n} AS (SELECT set_id, neighbour AS id, min(f * 100 + r) AS o FROM r{n} WHERE r <= 4 GROUP BY set_id, neighbour),
        l{n} AS (SELECT set_id, place, id FROM (SELECT set_id, id, (SELECT count(*) FROM ({before}) b WHERE b.set_id = c.set_id) + row_number() OVER (PARTITION BY set_id ORDER BY o) - 1 AS place
                 FROM c{n} c WHERE (set_id, id) NOT IN (SELECT (set_id, id) FROM ({before}) z)) w WHERE place < {_WALK})"""


@_query(f"""WITH {_EDGES}, d AS (SELECT DISTINCT caller, callee FROM e), bt AS (SELECT caller AS id, callee AS neighbour FROM d UNION SELECT callee, caller FROM d),
    dg AS (SELECT id, count(*) AS degree FROM (SELECT caller AS id FROM d UNION ALL SELECT callee FROM d) x GROUP BY id),
    nb AS (SELECT bt.id, neighbour, degree, s_name AS label, s_nationkey AS path FROM bt JOIN dg ON dg.id = neighbour JOIN supplier ON s_suppkey = neighbour),
    l0 AS (SELECT s_suppkey AS set_id, 0 AS place, s_suppkey AS id FROM supplier), {_level(1)}, {_level(2)}
    SELECT set_id, CAST(place AS INTEGER) AS place, id FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2) a""")
def graph_walks(spark: SparkSession, d: str) -> DataFrame:
    """A walk of at most 12 nodes around each supplier, all of them at once."""
    s = table(spark, d, "supplier")
    nodes = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"), F.col("s_nationkey").cast("string").alias("path"))
    rows = table(spark, d, "lineitem").count()
    pairs = stored(graph.pairs(Q._edges(spark, d)), rows=rows)
    out = stored(graph.walks(pairs, nodes, s.select(F.col("s_suppkey").alias("set_id"), F.lit(0).alias("place"), F.col("s_suppkey").alias("id")), _WALK), rows=rows)
    drop(pairs)
    return out


# ---- code search

_LEXICAL = f"lx AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY round(0.75 + s, 6) DESC, id) AS r FROM (SELECT id, round(greatest(0.0, CASE WHEN s > 0 THEN s + {_HOME.format(0.04)} ELSE 0.0 END - {_PEN}), 6) AS s FROM (SELECT *, {_FS} AS s FROM p) x) y WHERE s > 0) z WHERE r <= 30)"


@_query(f"""WITH {_V}, {_CODE}, {_LEXICAL}, fn AS (SELECT p.id, v.label AS file_id, v.v FROM p JOIN v ON v.vec_id = p.id),
    fl AS (SELECT label AS file_id, v FROM v WHERE vec_id IN (SELECT min(vec_id) FROM v GROUP BY label)),
    fs AS (SELECT * FROM (SELECT a.query_id, fl.file_id, row_number() OVER (PARTITION BY a.query_id ORDER BY round(list_inner_product(a.v, fl.v), 6) DESC, fl.file_id) AS r FROM a CROSS JOIN fl) x WHERE r <= 3),
    nr AS (SELECT a.query_id, fn.id, fn.file_id, round(list_inner_product(a.v, fn.v), 6) AS score FROM a CROSS JOIN fn),
    inf AS (SELECT * FROM (SELECT nr.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM nr WHERE (query_id, file_id) IN (SELECT query_id, file_id FROM fs)) x WHERE r <= 50),
    wide AS (SELECT * FROM (SELECT nr.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM nr) x WHERE r <= 100),
    ev AS (SELECT query_id, id, max(score) AS score FROM (SELECT query_id, id, score FROM inf UNION ALL SELECT query_id, id, score FROM wide UNION ALL SELECT query_id, id, score FROM nr WHERE id IN (SELECT id FROM lx)) x GROUP BY query_id, id),
    bo AS (SELECT id, {_PEN} > 0 AS pen, round({_hits('name', 0.09)} + {_hits('sig', 0.04)} + {_hits('path', 0.03)} + {_hits('doc', 0.02)} + {_HOME.format(0.025)} - {_PEN}, 6) AS b FROM p),
    z AS (SELECT query_id, id, round(score + b, 6) AS final_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score + b, 6) DESC, score DESC, pen, id) AS INTEGER) AS rank FROM ev JOIN bo USING (id))
    SELECT query_id, rank, id, final_score FROM z WHERE rank <= 10""")
def code_search(spark: SparkSession, d: str) -> DataFrame:
    """Parts as functions, labels as files: the vector of a part is that of its number, the vector of a file its label's first."""
    rows = Q._vectors(spark, d)
    parts = Q._code_rows(spark, d).drop("vector_score")
    functions = parts.join(rows.select(F.col("vec_id").alias("id"), F.col("label").alias("file_id"), "v"), "id")
    first = rows.groupBy("label").agg(F.min_by("v", "vec_id").alias("v")).withColumnRenamed("label", "file_id")
    tokens = code.query_tokens(F.lit(Q.QUESTION))
    words = code.text_hits(parts, code.function_score(tokens)).orderBy(F.desc("score"), "id").limit(30)
    return search.code_search(functions, first, Q._asked(rows), words, tokens, 3, 50, 10)


@_query(f"""WITH h AS (SELECT 'function' AS kind, id, score FROM ({ORACLES['code_text_score']}) f UNION ALL SELECT 'file', id, score FROM ({ORACLES['file_text_score']}) g),
    r AS (SELECT kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY score DESC, id) AS INTEGER) AS rank, CAST(id AS VARCHAR) AS id, score FROM h)
    SELECT *, true AS retrieval_degraded, true AS embedding_degraded FROM r WHERE rank <= 10""")
def code_search_text_only(spark: SparkSession, d: str) -> DataFrame:
    return search.text_only(Q.code_text_score(spark, d), Q.file_text_score(spark, d), 10)


def _retrieved(spark: SparkSession, d: str, recall: int, final: int, rerank: bool = False, **state: bool) -> DataFrame:
    scorer = F.col("score") * 1000 + F.col("chunk_id") % 97 if rerank else None
    return search.retrieve(*Q._lists(spark, d), recall, final, scorer, **state).withColumn("score", F.round("score", 6))


def _flags(*on: str) -> str:
    return ", ".join(f"{str(f in on).lower()} AS {f}" for f in search.FLAGS[:4])


@_query(f"WITH {_LISTS}, r AS (SELECT query_id, chunk_id, rank, retrieval_source, round(rrf_score * 1000 + chunk_id % 97, 9) AS s FROM fr WHERE rank <= 16), z AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS INTEGER) AS n FROM r) SELECT query_id, 'docs' AS source, chunk_id, round(s, 6) AS score, n AS rank, retrieval_source, {_flags()} FROM z WHERE n <= 5")
def retrieval_full(spark: SparkSession, d: str) -> DataFrame:
    return _retrieved(spark, d, 16, 5, rerank=True)


@_query(f"WITH {_LISTS} SELECT query_id, 'docs' AS source, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank, 'bm25' AS retrieval_source, {_flags('retrieval_degraded', 'qdrant_degraded')} FROM bl")
def retrieval_vector_raises(spark: SparkSession, d: str) -> DataFrame:
    return _retrieved(spark, d, 16, 64, vector_ok=False)


@_query(f"WITH {_LISTS} SELECT query_id, 'docs' AS source, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank, 'vector' AS retrieval_source, {_flags('retrieval_degraded')} FROM vl WHERE rank <= 16")
def retrieval_bm25_raises(spark: SparkSession, d: str) -> DataFrame:
    return _retrieved(spark, d, 16, 64, bm25_ok=False)


@_query(f"WITH {_LISTS} SELECT query_id, 'docs' AS source, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank, 'bm25' AS retrieval_source, {_flags('retrieval_degraded', 'embedding_degraded')} FROM bl WHERE rank <= 16")
def retrieval_unhealthy(spark: SparkSession, d: str) -> DataFrame:
    return _retrieved(spark, d, 16, 64, embedding_healthy=False)


@_query(f"WITH {_LISTS} SELECT query_id, 'docs' AS source, chunk_id, round(rrf_score, 6) AS score, CAST(rank AS INTEGER) AS rank, retrieval_source, {_flags('retrieval_degraded', 'reranker_degraded')} FROM fr WHERE rank <= 5")
def retrieval_reranker_down(spark: SparkSession, d: str) -> DataFrame:
    return _retrieved(spark, d, 16, 5, rerank=True, reranker_healthy=False)


@_query(f"""WITH {_V}, s AS (SELECT a.query_id, v.vec_id, v.label, round(list_inner_product(a.v, v.v), 6) AS score FROM a CROSS JOIN v),
    l AS (SELECT query_id, vec_id, score, 0 AS l, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS o FROM s WHERE label IN (1, 3, 5)
          UNION ALL SELECT query_id, vec_id, score, 1, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) FROM s),
    m AS (SELECT query_id, vec_id, max(score) AS score, min(l * 1000 + o) AS f FROM l WHERE o <= 10 GROUP BY query_id, vec_id)
    SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f) AS INTEGER) AS rank FROM m""")
def code_hits_merged(spark: SparkSession, d: str) -> DataFrame:
    """Hits in a few labels and hits anywhere as one list for each question."""
    lists = [q(spark, d).withColumnRenamed("rank", "ord") for q in (Q.vector_filtered, Q.vector_topk)]
    return code.merged_hits(lists, "query_id", "vec_id")


@_query("SELECT doc_id, sha256(array_to_string(list_slice(string_split(text, chr(10)), doc_id % 3 + 1, doc_id % 3 + 10), chr(10))) AS snippet FROM documents")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(search.snippet(F.col("text"), (F.col("doc_id") % 3 + 1).cast("int")), 256).alias("snippet"))


@_query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE p_brand END AS text FROM part")
def string_literals(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("p_size") % 3
    text = F.when(kind == 0, F.concat(F.lit('rb"'), "p_name", F.lit('"'))).when(kind == 1, F.concat(F.lit(' \'\'\''), "p_type", F.lit("\'\'\'"))).otherwise(F.concat(F.lit("'"), "p_brand", F.lit("'")))
    return table(spark, d, "part").select("p_partkey", lifecycle.strip_literal(text).alias("text"))


@_query("SELECT DISTINCT w.wanted, 'part:' || p.p_partkey AS id FROM part p JOIN (SELECT DISTINCT string_split(p_name, ' ')[-1] AS wanted FROM part) w ON string_split(p.p_name, ' ')[-1] = w.wanted")
def graph_matches(spark: SparkSession, d: str) -> DataFrame:
    """Nodes whose label ends in a wanted name: parts by the last words of all names."""
    p = spread(table(spark, d, "part"))
    label = F.replace("p_name", F.lit(" "), F.lit("."))
    nodes = p.select(lifecycle.node_id(F.lit("part"), F.col("p_partkey").cast("string")).alias("id"), label.alias("label"), F.concat(F.lit("#"), F.col("p_partkey").cast("string")).alias("name"))
    return graph.matching(nodes, p.select(F.element_at(F.split("p_name", " "), -1).alias("wanted")).distinct())


@_query("SELECT p_partkey, 'repo/' || lower(replace(p_brand, '#', '_')) AS source, p_name || CASE WHEN p_size % 2 = 0 THEN chr(10) || chr(10) || p_type ELSE '' END || chr(10) || chr(10) || p_brand AS text FROM part")
def code_results(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    source, text = search.result_of(F.lit("repo"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.lit(" ")), F.col("p_brand"))
    return p.select("p_partkey", source.alias("source"), text.alias("text"))


@_query("WITH r AS (SELECT p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rank FROM part) SELECT p_brand, string_agg('[' || rank || '] ' || p_partkey || chr(10) || p_name, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS prompt FROM r WHERE rank <= 8 GROUP BY p_brand")
def answer_prompts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").withColumn("rank", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")))
    return search.answer_list(rows, "p_brand", F.col("p_name"), F.col("p_partkey").cast("string"))


@_query(r"SELECT p_partkey, regexp_replace(substr('name: ' || p_name || chr(10) || chr(10) || 'type: ' || p_type, 1, 40), '\s+$', '') AS text FROM part")
def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", search.embedding_text({"name": F.col("p_name"), "docstring": F.lit(""), "type": F.col("p_type")}, 40).alias("text"))


@_query("""WITH x AS (SELECT label, vec_id % 2 AS m, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM embeddings),
    s AS (SELECT label, i, sum(e * m) / greatest((SELECT count(*) FROM embeddings b WHERE b.label = x.label AND b.vec_id % 2 = 1), 1e-9) AS e FROM x GROUP BY label, i),
    n AS (SELECT label, sqrt(sum(e * e)) AS n FROM s GROUP BY label)
    SELECT s.label, CAST(i AS INTEGER) AS i, round(e / CASE WHEN n > 0 THEN n ELSE 1 END, 5) AS e FROM s JOIN n USING (label)""")
def pooled_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of a label as token vectors, those of odd ids unmasked."""
    rows = table(spark, d, "embeddings").groupBy("label").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("m"))
    pooled = search.mean_pooled(F.transform("m", lambda x: x["embedding"]), F.transform("m", lambda x: (x["vec_id"] % 2).cast("double")))
    return rows.select("label", F.posexplode(pooled).alias("i", "e")).select("label", (F.col("i") + 1).alias("i"), F.round("e", 5).alias("e"))


@_query("""WITH r AS (SELECT p_partkey % 130 AS idx, replace(p_name, ' ', '.') AS name, row_number() OVER (PARTITION BY p_partkey % 130 ORDER BY p_partkey) AS rank FROM part),
    c AS (SELECT DISTINCT idx, list_value(CASE WHEN idx % 3 = 0 THEN 'missing' ELSE string_split(name, '.')[-1] END, 'x.' || string_split(name, '.')[-1]) AS targets FROM r WHERE rank = CASE WHEN idx % 2 = 0 THEN 2 ELSE 9 END),
    t AS (SELECT c.idx, r.name, unnest(c.targets) AS target FROM c LEFT JOIN r ON r.idx = c.idx AND r.rank <= 5),
    h AS (SELECT idx, max(CASE WHEN name = target OR ends_with(name, '.' || target) OR ends_with(name, '::' || target) OR (contains(target, '.') AND (ends_with(name, target) OR name = string_split(target, '.')[-1])) THEN 1 ELSE 0 END) AS hit FROM t GROUP BY idx)
    SELECT count(*) AS n, round(coalesce(avg(hit), 0.0), 6) AS recall, round(coalesce(avg(CASE WHEN idx < 100 THEN hit END), 0.0), 6) AS single, round(coalesce(avg(CASE WHEN idx >= 100 THEN hit END), 0.0), 6) AS ambiguous FROM h""")
def code_recall(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select((F.col("p_partkey") % 130).alias("idx"), "p_partkey", F.replace("p_name", F.lit(" "), F.lit(".")).alias("name"))
    ranked = p.withColumn("rank", F.row_number().over(Window.partitionBy("idx").orderBy("p_partkey")))
    last = F.element_at(F.split("name", r"\."), -1)
    at = F.when(F.col("idx") % 2 == 0, 2).otherwise(9)
    cases = ranked.filter(F.col("rank") == at).select("idx", F.array(F.when(F.col("idx") % 3 == 0, F.lit("missing")).otherwise(last), F.concat(F.lit("x."), last)).alias("targets"))
    return search.code_recall(ranked, cases, 5, 100)


# ---- sessions


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as sessions of customers."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("title"))


def _asking(rows: DataFrame) -> DataFrame:
    """Customers of even numbers ask for their own sessions, others for those of the next customer."""
    return rows.withColumn("user_id", F.when(F.col("user_id") % 2 == 0, F.col("user_id")).otherwise(F.col("user_id") + 1))


@_query("SELECT o_orderkey AS session_id, o_custkey AS user_id, CASE WHEN o_orderkey % 5 = 0 AND o_custkey % 2 = 0 THEN 'New name' ELSE o_orderpriority END AS title FROM orders")
def session_rename(spark: SparkSession, d: str) -> DataFrame:
    s = _sessions(spark, d)
    asked = _asking(s.filter("session_id % 5 = 0"))
    first, last = (asked.withColumn("title", F.lit(t)).withColumn("place", F.lit(i)) for i, t in enumerate(("zebra", "  New \n name ")))
    return lifecycle.renamed(s, last.unionByName(first))


@_query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT (l_orderkey % 7 = 0 AND EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_custkey % 2 = 0))")
def session_delete(spark: SparkSession, d: str) -> DataFrame:
    s = _sessions(spark, d)
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("session_id"), "l_linenumber")
    left = lifecycle.owned_delete(s, m, _asking(s.filter("session_id % 7 = 0")))[1]
    return left.select(F.col("session_id").alias("l_orderkey"), "l_linenumber")


@_query("""WITH s AS (SELECT o_orderkey AS k, o_orderpriority AS title, o_orderstatus AS status FROM orders WHERE o_orderkey % 2 = 0),
    h AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 <> 0 THEN 'hot' END AS title, o_orderstatus || '*' AS status FROM orders WHERE o_orderkey % 3 = 0)
    SELECT coalesce(h.k, s.k) AS k, coalesce(h.title, s.title) AS title, coalesce(h.status, s.status) AS status FROM s FULL OUTER JOIN h ON s.k = h.k""")
def hot_sessions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("status"))
    hot = o.filter("k % 3 = 0").select("k", F.when(F.col("k") % 9 != 0, F.lit("hot")).alias("title"), F.concat("status", F.lit("*")).alias("status"))
    return lifecycle.hot_sessions(o.filter("k % 2 = 0"), hot, "k")


@_query("SELECT conv_id AS session_id, max(turn) AS last_seq, arg_max(role, turn) AS summary, CAST(arg_max(length(text), turn) AS INTEGER) AS compacted FROM conversations WHERE turn >= 2 GROUP BY conv_id")
def pending_state(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "conversations").filter("turn >= 2").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("last_seq"), F.col("role").alias("summary"), F.length("text").alias("compacted"))
    return lifecycle.pending_state(e)


@_query("SELECT conv_id AS session_id, count(*) AS n FROM conversations WHERE role <> 'user' GROUP BY conv_id")
def malformed_references(spark: SparkSession, d: str) -> DataFrame:
    e = Q._exchange(spark, d)
    return lifecycle.referenced(e, e.filter("role = 'user'").select("session_id", "event_id"))[1].groupBy("session_id").agg(F.count("*").alias("n"))


@_query("""WITH e AS (SELECT event_id, 'c' || (user_id % 3) AS owner, epoch(ts) AS s FROM events)
    SELECT event_id, CASE WHEN owner <> 'c0' AND 1705276800 - s >= 30 THEN 'c0' ELSE owner END AS owner, owner <> 'c0' AND 1705276800 - s >= 30 AS claimed FROM e""")
def stale_claims(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("owner"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("delivered_at"))
    return lifecycle.claimed(e, F.lit(1705276800.0), 30.0, "c0").select("event_id", "owner", "claimed")


@_query("WITH u AS (SELECT user_id, max(epoch(ts)) AS last_at FROM events WHERE event_type = 'purchase' GROUP BY user_id) SELECT user_id FROM u WHERE 1706400000 - last_at < 604800")
def alive_sessions(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "events").filter("event_type = 'purchase'").groupBy("user_id").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("last_at"))
    return lifecycle.alive(u, "last_at", F.lit(1706400000.0), lifecycle.SESSION_TTL).select("user_id")


@_query("""WITH e AS (SELECT event_id, user_id, event_type = 'view' AS ping, event_type <> 'error' AS ok FROM events),
    w AS (SELECT *, last_value(CASE WHEN ping AND ok THEN false WHEN NOT ping AND NOT ok THEN true END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS op FROM e)
    SELECT event_id, CASE WHEN NOT ping AND coalesce(op, false) THEN 'refused' WHEN ok THEN 'passed' ELSE 'failed' END AS state FROM w""")
def circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type") == "view", "ping").otherwise("call").alias("kind"), (F.col("event_type") != "error").alias("ok"))
    return lifecycle.breaker(e, "user_id", "event_id").select("event_id", "state")


@_query("SELECT event_id, CAST(event_id % 3 AS INTEGER) AS replica, event_id < 100000 AS admitted FROM events")
def replica_choice(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", lifecycle.replica(F.col("event_id"), F.array(F.lit(0), F.lit(1), F.lit(2))).alias("replica"))
    return lifecycle.admitted(e, F.col("event_id"))


# ---- accounts


@_query("SELECT c_custkey, strftime(greatest(TIMESTAMP '1995-06-01', coalesce((SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey), TIMESTAMP '1995-06-01')), '%Y-%m-%d') AS last_seen FROM customer")
def last_seen(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.lit("1995-06-01").cast("timestamp_ntz").alias("last_seen_at"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("last_seen_at"))
    return lifecycle.touched(c, "c_custkey", o, "last_seen_at").select("c_custkey", F.date_format("last_seen_at", "yyyy-MM-dd").alias("last_seen"))


@_query("""SELECT n_name AS name, CASE WHEN n_regionkey IN (1, 2) AND (n_name <> 'BRAZIL' OR n_nationkey % 2 = 1) THEN CASE WHEN n_nationkey % 2 = 1 THEN 'x' END ELSE CAST(n_nationkey AS VARCHAR) END AS value,
    CASE WHEN n_regionkey IN (1, 2) AND (n_name <> 'BRAZIL' OR n_nationkey % 2 = 1) THEN 'stored' ELSE 'default' END AS origin FROM nation""")
def runtime_settings(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    stored = n.filter("n_regionkey in (1, 2)").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 1, F.lit("x")).alias("value"))
    return lifecycle.runtime_settings(stored, n.select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("value")), "BRAZIL")


@_query("""WITH u AS (SELECT c_custkey, c_acctbal > 0 AS a, c_custkey % 4 = 0 AS p, c_mktsegment = 'BUILDING' AS b, c_custkey % 10 = 1 AS s FROM customer)
    SELECT c_custkey, a AS signed_in, a AND NOT p AS ready, a AND NOT p AND (b OR s) AS admin, a AND NOT p AND s AS superuser FROM u""")
def role_guards(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("is_active"), (F.col("c_custkey") % 4 == 0).alias("must_change_password"), (F.col("c_mktsegment") == "BUILDING").alias("is_admin"), (F.col("c_custkey") % 10 == 1).alias("is_superuser"))
    return u.select("c_custkey", *[c.alias(k) for k, c in lifecycle.roles().items()])


@_query("SELECT username, username = 'Supplier#000000001' AS is_superuser FROM (SELECT c_name AS username FROM customer UNION SELECT s_name FROM supplier) x")
def bootstrap(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer").select(F.col("c_name").alias("username"), (F.col("c_custkey") == 1).alias("is_superuser"))
    names = table(spark, d, "supplier").select(F.col("s_name").alias("username"))
    return lifecycle.bootstrapped(users, names.unionByName(names).unionByName(users.select("username").filter("is_superuser")), "Supplier#000000001")


# ---- documents and versions


def _keys(spark: SparkSession, d: str) -> DataFrame:
    end = F.when(F.col("doc_id") % 3 == 0, ".MD").when(F.col("doc_id") % 3 == 1, ".md").otherwise(".txt")
    return table(spark, d, "documents").select(F.concat(F.when(F.col("doc_id") % 5 == 0, "other/").otherwise("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), end).alias("key"))


@_query("SELECT 'docs/' || s AS key, s AS source FROM (SELECT source || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.MD' ELSE '.md' END AS s FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 3 <> 2) x")
def object_keys(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.object_keys(_keys(spark, d), "/docs/")


@_query("""WITH l AS (SELECT o_custkey AS key, max(o_orderkey) AS v, min(o_orderkey) AS f FROM orders GROUP BY o_custkey)
    SELECT key, CASE WHEN key % 2 = 0 THEN f ELSE v END AS version_id, (SELECT o_orderpriority FROM orders WHERE o_orderkey = CASE WHEN key % 2 = 0 THEN f ELSE v END) AS text FROM l""")
def versioned_reads(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version_id"), F.col("o_orderkey").alias("modified"), F.col("o_orderpriority").alias("text"))
    wanted = o.groupBy("key").agg(F.min("version_id").alias("f")).select("key", F.when(F.col("key") % 2 == 0, F.col("f")).alias("version_id"))
    return lifecycle.versioned_text(o, wanted)


@_query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source || '/a.md' WHEN 1 THEN 'b-' || doc_id || '.md' ELSE 'x.md' END AS source FROM documents")
def display_sources(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/srv/project\\"), "source", F.lit("\\a.md"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("/data/docs/b-"), F.col("doc_id").cast("string"), F.lit(".md"))).otherwise(F.lit("C:\\tmp\\x.md"))
    return table(spark, d, "documents").select("doc_id", lifecycle.display_source(path, "/srv/project/", "/data/docs").alias("source"))


@_query("SELECT doc_id, CAST('0x' || substr(sha256(doc_id || '|' || source || '|' || n_chars), 1, 12) AS BIGINT) AS signature FROM documents")
def signature_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", lifecycle.signature_number([F.col("doc_id").cast("string"), F.col("source"), F.col("n_chars").cast("string")]).alias("signature"))


@_query("SELECT repository, count(*) AS n FROM (SELECT CASE WHEN doc_id % 13 = 0 THEN 'fallback' ELSE source END AS repository FROM documents WHERE doc_id % 13 = 0 OR doc_id % 11 <> 0) x GROUP BY repository")
def repository_discovery(spark: SparkSession, d: str) -> DataFrame:
    file = F.concat(F.col("doc_id").cast("string"), F.lit(".py"))
    path = F.when(F.col("doc_id") % 13 == 0, file).when(F.col("doc_id") % 11 == 0, F.concat(F.lit(".git/"), file)).otherwise(F.concat("source", F.lit("/src/"), file))
    return lifecycle.repositories(table(spark, d, "documents").select(path.alias("path")), "fallback")


@_query("SELECT lang, count(*) AS document_count, sha256(CAST(to_json(list(struct_pack(doc_id := doc_id, source := source) ORDER BY doc_id)) AS VARCHAR)) AS documents FROM documents GROUP BY lang")
def manifest_payloads(spark: SparkSession, d: str) -> DataFrame:
    rows = lifecycle.manifest_payload(table(spark, d, "documents"), "lang", ["doc_id", "source"])
    return rows.withColumn("documents", F.sha2("documents", 256))


# ---- load


@_query("""SELECT event_type, arg_max(event_id, event_id) - arg_min(event_id, event_id) AS requests, arg_max(user_id, event_id) - arg_min(user_id, event_id) AS batches,
    round(CASE WHEN arg_max(user_id, event_id) = arg_min(user_id, event_id) THEN 0.0 ELSE CAST(arg_max(event_id, event_id) - arg_min(event_id, event_id) AS DOUBLE) / (arg_max(user_id, event_id) - arg_min(user_id, event_id)) END, 6) AS mean_batch FROM events GROUP BY event_type""")
def batch_growth(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "event_id", F.col("event_id").alias("requests"), F.col("user_id").alias("batches"))
    return lifecycle.batch_growth(e, "event_type", "event_id")


@_query("SELECT event_type, max(user_id) AS peak, round(avg(user_id), 6) AS mean, round(coalesce(regr_slope(user_id, event_id), 0.0), 6) AS slope FROM events GROUP BY event_type")
def backlog(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.backlog(table(spark, d, "events"), "event_type", "event_id", "user_id")


@_query("""SELECT conv_id, turn, CASE WHEN role = 'user' THEN turn + 500 ELSE turn END AS id, role, sha256(text) AS content, turn % 2 = 1 AS used_rag, CAST(CASE WHEN turn % 3 = 0 THEN 2 ELSE 0 END AS INTEGER) AS n_contexts FROM conversations""")
def archived_messages(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "conversations")
    contexts = F.when(F.col("turn") % 3 == 0, F.lit('[{"source": "a", "text": "x", "score": 0.5}, {"source": "b"}]'))
    payload = F.to_json(F.struct(F.col("turn").alias("id"), F.when(F.col("role") == "user", F.col("turn") + 500).alias("session_seq"), "role", F.col("text").alias("content"), contexts.alias("contexts"), F.when(F.col("turn") % 2 == 1, F.lit(True)).alias("used_rag")))
    return m.select("conv_id", "turn", lifecycle.archived_message(payload).alias("m")).select("conv_id", "turn", "m.id", "m.role", F.sha2("m.content", 256).alias("content"), "m.used_rag", "m.n_contexts")


# ---- models


def _middle(text: str, limit: int) -> str:
    """SQL of trim_text's cut in the middle."""
    head = (limit - len(T.MARKER)) // 2
    tail, marker = limit - len(T.MARKER) - head, "'" + T.MARKER.replace("'", "''") + "'"
    t = _STRIP.format(f"coalesce({text}, '')")
    return f"""CASE WHEN length({t}) <= {limit} THEN {t} ELSE {_STRIP.format(f"regexp_replace(left({t}, {head}), '\\s+$', '') || {marker} || regexp_replace(right({t}, {tail}), '^\\s+', '')")} END"""


@_query(f"""WITH c AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 0 THEN NULL ELSE 'kept from before' END AS old, CASE WHEN turn % 5 = 0 THEN '' ELSE text END AS history, CASE WHEN turn % 2 = 0 THEN NULL ELSE 'merged: ' || text END AS reply FROM conversations),
    p AS (SELECT *, concat_ws(chr(10), nullif({_middle('old', 90)}, ''), nullif({_middle('history', 70)}, '')) AS both_ FROM c)
    SELECT conv_id, turn, CASE WHEN coalesce(history, '') = '' THEN {_middle('old', 90)} WHEN reply IS NULL THEN {_middle('both_', 90)} ELSE {_middle('reply', 90)} END AS summary FROM p""")
def remembered_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Replies are made from the turn; each second call has failed, and each fifth turn has nothing to merge."""
    turn, text = F.col("turn"), F.col("text")
    old = F.when(turn % 3 != 0, "kept from before")
    reply = F.when(turn % 2 != 0, F.concat(F.lit("merged: "), text))
    return table(spark, d, "conversations").select("conv_id", "turn", models.remembered(old, F.when(turn % 5 == 0, "").otherwise(text), reply, 90, 70).alias("summary"))


def _letters():
    """A stand-in for a model: length, number of e, one."""
    return lambda texts, task, prompt_name: [[len(t), t.count("e"), 1] for t in texts]


@_query("""WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS a, length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')) AS b FROM documents)
    SELECT doc_id, round(a / sqrt(CAST(a AS DOUBLE) * a + b * b + 1), 6) AS x, round(b / sqrt(CAST(a AS DOUBLE) * a + b * b + 1), 6) AS y FROM n""")
def embedded_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    v = F.col("embedding")
    return models.encoded(docs, "text", _letters, task="retrieval.passage").select("doc_id", F.round(v[0], 6).alias("x"), F.round(v[1], 6).alias("y"))


# ---- SQL of queries in other modules

SQL["health_status"] = f"SELECT user_id, CASE WHEN arg_max(degraded, event_id) THEN 'degraded' ELSE 'healthy' END AS status FROM ({ORACLES['health_hysteresis']}) h GROUP BY user_id"
SQL["request_batches"] = """WITH RECURSIVE e AS (SELECT event_type, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS rn FROM events),
    x AS (SELECT event_type, rn, least(rn + 16, 1 + max(rn) OVER (PARTITION BY event_type ORDER BY sec RANGE BETWEEN CURRENT ROW AND 3600 FOLLOWING)) AS following FROM e),
    b AS (SELECT event_type, rn, following FROM x WHERE rn = 1 UNION ALL SELECT x.event_type, x.rn, x.following FROM b JOIN x ON x.event_type = b.event_type AND x.rn = b.following)
    SELECT event_type, count(*) AS batches, max(following - rn) AS largest, CAST(sum(following - rn) AS BIGINT) AS requests FROM b GROUP BY event_type"""

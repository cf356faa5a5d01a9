"""The engine's queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import misc as M
from ..functions import text as T
from ..operators import accounts, chunking, code, dml, evaluation, fusion, graph, lexical, postings, routing, sessions, vectors, versions
from ..sources.files import table
from ..sources.scratch import dealt, drop, spread, stored
from ..streaming.archive import windowed_counts

ASKED = 10


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents, dealt to all cores where their files are fewer."""
    return spread(table(spark, d, "documents"))


def _bm25(spark: SparkSession, d: str, k: int, wanted: Column | None = None) -> DataFrame:
    """The k best documents of each benchmark item, as a scratch table; texts are tokenised once."""
    asked = stored(lexical.asked_tokens(table(spark, d, "benchmark"), "item_id"))
    made = stored(postings.blocks(_documents(spark, d), "doc_id", only=asked, wanted=wanted))
    found = stored(postings.best(made, asked, "item_id", k, *postings.statistics(made), postings.frequencies(made)))
    drop(asked, made)
    return found.withColumnRenamed("key", "doc_id")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, ASKED).select("item_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, ASKED, F.col("lang") == "en").select("item_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    return lexical.corpus_statistics(table(spark, d, "documents")).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


def bm25_df(spark: SparkSession, d: str) -> DataFrame:
    return lexical.document_frequency(lexical.postings(table(spark, d, "documents").select("doc_id", "text"), "doc_id"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", vectors.normalized(vectors.finite(F.col("embedding"))).alias("v"))


def _asked(rows: DataFrame) -> DataFrame:
    """The questions: every vector whose id is divisible by 100."""
    return rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "v")


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    return lexical.top(vectors.nearest(rows.select("vec_id", "v"), _asked(rows), k=ASKED), "query_id", "score", "vec_id", ASKED)


def vector_threshold(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    return vectors.nearest(rows.select("vec_id", "v"), _asked(rows), 0.2)


def vector_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    return lexical.top(vectors.nearest(rows.filter(F.col("label").isin(1, 3, 5)).select("vec_id", "v"), _asked(rows), k=ASKED), "query_id", "score", "vec_id", ASKED)


def vector_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    return rows.select("vec_id", F.round(F.sqrt(vectors.dot(F.col("v"), F.col("v"))), 6).alias("norm"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


def rescore_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Wanted vectors bring their order along, so that pairs (questions times vectors) are joined with nothing and not shuffled."""
    rows = _vectors(spark, d)
    want = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("vec_id")).agg(F.min("o_orderkey").alias("ord"))
    known = rows.join(want, "vec_id").select(F.struct("ord", "vec_id").alias("vec_id"), "v")
    return vectors.nearest(known, _asked(rows)).select("query_id", "vec_id.ord", "vec_id.vec_id", "score")


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = _bm25(spark, d, 64).select(F.col("item_id").alias("query_id"), F.lit("docs").alias("source"), F.col("doc_id").alias("chunk_id"), "score", "rank")
    rows = _vectors(spark, d)
    asks = rows.join(table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "v")
    v = lexical.top(vectors.nearest(rows.select("vec_id", "v"), asks, k=64), "query_id", "score", "vec_id", 64)
    return v.select("query_id", F.lit("docs").alias("source"), F.col("vec_id").alias("chunk_id"), "score", "rank"), b


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "rank", "source", "chunk_id", "rrf_score", "retrieval_source", F.round("vector_score", 6).alias("vector_score"), F.round("bm25_score", 6).alias("bm25_score"))


def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return _shown(fusion.fused(*_lists(spark, d), 64))


def hybrid_degraded(spark: SparkSession, d: str) -> DataFrame:
    return fusion.degraded(*_lists(spark, d), 16, bm25_ok=True, vector_ok=True, healthy=False).withColumn("score", F.round("score", 6))


def rerank_batched(spark: SparkSession, d: str) -> DataFrame:
    rows = fusion.fused(*_lists(spark, d), 64).join(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "n_chars"), "chunk_id")
    return fusion.reranked(rows, F.col("rrf_score") * 1000 + F.col("n_chars") % 97, 5, 16).select("query_id", "new_rank", "chunk_id", "batch", "rerank_score", "rrf_score")


def anchor_route(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    anchors = lambda label: rows.filter(F.col("label") == label).select(F.col("vec_id").alias("anchor_id"), "v")
    return vectors.anchor_route(rows.select("vec_id", "v"), anchors(0), anchors(1), 0.2, 0.2, 0.02)


DOMAIN = ["thehe", "license", "benchmark"]


def keyword_route(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").filter("role = 'user'")
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = F.lag("turn").over(w).isNotNull()
    routed = rows.select("conv_id", "turn", routing.route(F.col("text"), before, before, DOMAIN).alias("route"))
    return routed.withColumn("use_rag", ~F.col("route").endswith("direct"))


def _cases(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")  # noqa: E741
    return l.select(F.col("doc_id").alias("id"), "lang", (F.col("quality") == 1).alias("expected"), (F.col("toxic") == 0).alias("predicted"), (F.col("n_chars") > 500).alias("other"))


def route_confusion(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.confusion(_cases(spark, d), [])


def route_by_category(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.confusion(_cases(spark, d), ["lang"])


def route_ab(spark: SparkSession, d: str) -> DataFrame:
    c = _cases(spark, d)
    return evaluation.variants(c, c.select("id", "expected", F.col("other").alias("predicted")))


def recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    """Gold: documents that hold the item's passage whole."""
    ranked = _bm25(spark, d, ASKED).select(F.col("item_id").alias("query_id"), "doc_id", "rank")
    items, docs = table(spark, d, "benchmark").filter("text is not null"), _documents(spark, d).select("doc_id", "text")
    # Only documents that hold the rarest of an item's tokens can hold its text: an equi-join by that token finds them, whole texts decide.
    token = lexical.lexical_tokens(F.col("text"))
    asked = items.select("item_id", F.col("text").alias("_item"), F.explode(F.array_distinct(token)).alias("token"))
    own = docs.select("doc_id", "text", F.array_distinct(token).alias("tokens"))
    df = own.select(F.explode("tokens").alias("token")).join(F.broadcast(asked.select("token").distinct()), "token", "left_semi").groupBy("token").count()
    rarest = asked.join(df, "token").groupBy("item_id", "_item").agg(F.min_by("token", F.struct("count", "token")).alias("token"))
    found = own.select("doc_id", F.explode("tokens").alias("token")).join(rarest, "token").select("item_id", "doc_id", "_item")
    whole = found.join(docs, "doc_id").filter(F.contains("text", F.col("_item")))
    return evaluation.retrieval(ranked, whole.select(F.col("item_id").alias("query_id"), "doc_id"), 5)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.latencies(_events(spark, d), "event_type", "value").select("event_type", "n", "avg", F.round("min", 6).alias("min"), F.round("max", 6).alias("max"), "p50", "p95", "p99")


def latency_slope(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.slope(_events(spark, d), "event_type", "value", "event_id")


def latency_index_percentile(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.index_percentile(_events(spark, d), "event_type", "value", 0.95).select("event_type", F.round("p", 6).alias("p"), "median")


def top_sources(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.top_values(table(spark, d, "documents"), "source", 5)


def health_hysteresis(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("event_id", "user_id", (F.col("event_type") != "error").alias("ok"))
    return sessions.hysteresis(rows, "user_id", ["event_id"])


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents as they were and as they are: a tenth gone, a tenth changed, a tenth new."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"), F.sha2(F.concat("text", F.lit("+")), 256).alias("changed"))
    before = docs.filter("doc_id % 10 <> 2").select("doc_id", "source", "digest")
    now = docs.filter("doc_id % 10 <> 0").select("doc_id", "source", F.when(F.col("doc_id") % 10 == 1, F.col("changed")).otherwise(F.col("digest")).alias("digest"))
    return before, now


def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    return versions.difference(*_snapshots(spark, d), "doc_id", ["source", "digest"])


def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    return manifest_diff(spark, d).groupBy("status").agg(F.count("*").alias("n"))


def sync_plan(spark: SparkSession, d: str) -> DataFrame:
    before, now = _snapshots(spark, d)
    return versions.sync_plan(now, before, "doc_id", "digest", True)


def copy_unchanged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(manifest_diff(spark, d).filter("status = 'unchanged'"), "doc_id", "left_semi").select("doc_id", "source", "n_chars")


def index_changed(spark: SparkSession, d: str) -> DataFrame:
    return _snapshots(spark, d)[1].join(manifest_diff(spark, d).filter("status in ('added', 'modified')"), "doc_id", "left_semi")


def version_retention(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("version"), (F.col("event_type") == "error").alias("deleted"))
    return versions.retained(rows, "key", [F.desc("version")], 2)


def collection_retention(spark: SparkSession, d: str) -> DataFrame:
    return versions.newest_tables(table(spark, d, "customer").select(F.col("c_name").alias("name")), "Customer#000000001", 5)


def content_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


def signature(spark: SparkSession, d: str) -> DataFrame:
    return versions.fingerprint(table(spark, d, "documents"), ["doc_id", "source", "n_chars"])


def point_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.name_uuid(T.URL_NAMESPACE, F.concat_ws(":", "source", F.col("doc_id").cast("string"))).alias("point_id"))


def user_counts(spark: SparkSession, d: str) -> DataFrame:
    c, o, l = (table(spark, d, t) for t in ("customer", "orders", "lineitem"))  # noqa: E741
    j = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").join(l.select("l_orderkey", "l_linenumber"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.groupBy("c_custkey", "c_name").agg(F.countDistinct("o_orderkey").alias("session_count"), F.count("l_orderkey").alias("message_count"))


def seq_backfill(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") != "assistant", F.col("turn") + 1).alias("seq"))
    return sessions.backfilled(m, "conv_id", "turn", "seq")


def max_seq(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("max_seq"), F.count("*").alias("n_messages"))


def session_list(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, d, "orders").withColumn("place", F.row_number().over(w)).filter("place <= 50").select("o_custkey", "place", "o_orderkey")


def message_list(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last(F.when(F.col("role") != "system", F.col("turn"))), "turn")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.row_number().over(w).alias("place"))


def prompt_history(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").withColumn("_r", F.row_number().over(w)).filter("_r > 2").select("conv_id", "turn", "role")


def _history(spark: SparkSession, d: str) -> DataFrame:
    return sessions.clean_history(table(spark, d, "conversations"))


def history_recent(spark: SparkSession, d: str) -> DataFrame:
    return sessions.formatted(sessions.recent(_history(spark, d), 4))


def last_user_two(spark: SparkSession, d: str) -> DataFrame:
    two = sessions.recent(_history(spark, d).filter("role = 'user'"), 2)
    rows = two.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "content"))).alias("m"))
    return rows.select("conv_id", T.trim_text(F.array_join(F.transform("m", lambda x: x["content"]), "\n"), 300, "tail").alias("search_query"))


def previous_route(spark: SparkSession, d: str) -> DataFrame:
    r = sessions.last_exchange(_history(spark, d))
    return r.select("conv_id", "assistant_turn", T.trim_text(F.col("assistant_text"), 60, "head").alias("excerpt"), "user_text")


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.token_estimate(F.col("text")).alias("tokens"))


def compaction(spark: SparkSession, d: str) -> DataFrame:
    return sessions.compaction(_history(spark, d), 2, 100)


def trim_text(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", T.trim_text(t, 40, "head").alias("head"), T.trim_text(t, 40, "tail").alias("tail"), T.trim_text(t, 60, "middle").alias("middle"))


def clean_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.clean_title(F.col("text"), 24).alias("title"))


def _exchange(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "conversations")
    return m.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("event_id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role")


def archive_idempotent(spark: SparkSession, d: str) -> DataFrame:
    e = _exchange(spark, d)
    known = e.filter("role = 'user'")
    clash = e.filter("role = 'user'").withColumn("event_id", F.concat("event_id", F.lit("x")))
    batch = e.unionByName(e.filter("role = 'assistant'")).unionByName(clash).unionByName(e.limit(0).withColumn("event_id", F.lit("")))
    s = e.select("session_id").distinct().withColumn("archive_seq", F.lit(0).cast("long"))
    return sessions.archive(known, batch, s)[0]


def archive_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = _exchange(spark, d)
    s = e.select("session_id").distinct().withColumn("archive_seq", F.lit(1).cast("long"))
    return sessions.archive(e.limit(0), e, s)[1]


def pending_overlay(spark: SparkSession, d: str) -> DataFrame:
    e = _exchange(spark, d)
    late = e.filter("seq >= 2").withColumn("role", F.concat(F.lit("pending-"), F.col("role")))
    return sessions.overlaid(e.filter("seq < 4"), late)


def role_merge(spark: SparkSession, d: str) -> DataFrame:
    r = sessions.role_runs(table(spark, d, "conversations"))
    return r.select("conv_id", F.col("run").cast("long").alias("run"), "role", F.sha2("content", 256).alias("content_hash"))


def upsert_nothing(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return dml.insert_new(c.filter("c_acctbal >= 0"), c.withColumn("c_name", F.lit("new")), ["c_custkey"])


def upsert_update(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return dml.upsert(c, c.filter("c_acctbal < 0").withColumn("c_name", F.lit("changed")), ["c_custkey"])


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    c, o, l = (table(spark, d, t) for t in ("customer", "orders", "lineitem"))  # noqa: E741
    left = dml.cascade(c, [(o, "o_custkey", "o_orderkey"), (l, "l_orderkey", "l_linenumber")], F.col("c_acctbal") < 0, "c_custkey")
    parts = [x.agg(F.lit(n).alias("table_name"), F.count("*").alias("n")) for n, x in zip(("customer", "orders", "lineitem"), left, strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def constraint_checks(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "conversations")
    return dml.violations(m, [["conv_id", "turn"], ["text"]], {"role": F.col("role").isin("user", "assistant"), "text": F.length("text") > 0})


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    s = T.sentences(F.col("text"))
    return _documents(spark, d).select("doc_id", F.size(s).alias("n_sentences"), F.sha2(F.array_join(s, "\n"), 256).alias("digest"))


def clause_split(spark: SparkSession, d: str) -> DataFrame:
    s = T.clauses(F.col("text"))
    return _documents(spark, d).select("doc_id", F.size(s).alias("n_clauses"), F.sha2(F.array_join(s, "\n"), 256).alias("digest"))


def chunk_docs(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunked(_documents(spark, d), "doc_id", chunking.char_tokenizer, 800, 1000, 0, 0)


def chunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunked(_documents(spark, d), "doc_id", chunking.char_tokenizer, 800, 1000, 100, 200)


def _code_rows(spark: SparkSession, d: str) -> DataFrame:
    """Parts as functions: names, types and brands stand for paths, signatures and names."""
    p = table(spark, d, "part")
    path = F.concat(F.when(F.col("p_size") % 7 == 0, F.lit("lib/tests/")).when(F.col("p_size") % 3 == 0, F.lit("lib/src/")).otherwise(F.lit("lib/")), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit(".py"))
    return p.select(F.col("p_partkey").alias("id"), F.replace("p_name", F.lit(" "), F.lit(".")).alias("qualified_name"), F.col("p_type").alias("signature"), path.alias("path"), F.concat_ws(" ", "p_name", "p_brand").alias("docstring"), F.round(F.col("p_retailprice") / 10000, 6).alias("vector_score"))


QUESTION = "part brand_1 standard 12"


def code_text_score(spark: SparkSession, d: str) -> DataFrame:
    return code.text_hits(_code_rows(spark, d), code.function_score(code.query_tokens(F.lit(QUESTION)))).select("id", "score")


def file_text_score(spark: SparkSession, d: str) -> DataFrame:
    return code.text_hits(_code_rows(spark, d), code.file_score(code.query_tokens(F.lit(QUESTION)), F.col("docstring"))).select("id", "score")


def code_rank(spark: SparkSession, d: str) -> DataFrame:
    return code.ranked(_code_rows(spark, d), code.query_tokens(F.lit(QUESTION)), "path", 3).select("path", "rank", "id", "final_score")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of one order as a call graph: each line item calls the next of its order. Many orders are dealt finer, as a task sorts whole lines."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")  # noqa: E741
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    return dealt(l, l.count(), "l_orderkey").select(F.col("l_suppkey").alias("caller"), F.lead("l_suppkey").over(w).alias("callee"), "l_linenumber").filter("callee is not null")


def call_chain(spark: SparkSession, d: str) -> DataFrame:
    return graph.chain(_edges(spark, d), spark.createDataFrame([(1,), (5,)], "id long"), 3)[0]


def callers(spark: SparkSession, d: str) -> DataFrame:
    return graph.callers(_edges(spark, d), spark.createDataFrame([(5,), (9,)], "id long"))


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"), F.col("s_nationkey").cast("string").alias("path"))
    rows = table(spark, d, "lineitem").count()
    pairs = stored(graph.pairs(_edges(spark, d)), rows=rows)
    out = stored(graph.ranked_neighbours(pairs, nodes, spark.createDataFrame([(1,), (5,)], "id long")), rows=rows)
    drop(pairs)
    return out


def edge_lines(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).groupBy("caller", "callee").agg(F.array_join(F.array_sort(F.collect_set("l_linenumber")), ",").alias("lines"))


def public_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.public_source(F.regexp_replace("url", "^https?:", "")).alias("source"))


def auth_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as sign-ins of customers."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("token_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("expires_at"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), (F.col("c_acctbal") > 0).alias("is_active"))
    return accounts.signed_in(o, c, F.lit("1996-01-01").cast("timestamp_ntz")).select("token_id", "user_id", "username")


def expired_sessions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("token_id"), F.col("o_orderdate").alias("expires_at"))
    return accounts.expired(o, F.lit("1996-01-01").cast("timestamp_ntz")).select("token_id")


def demotable(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    users = c.select(F.col("c_custkey").alias("user_id"), (F.col("c_mktsegment") == "BUILDING").alias("is_admin"), (F.col("c_acctbal") > 0).alias("is_active"), (F.col("c_custkey") == 1).alias("is_superuser"))
    return accounts.may_demote(users).select("user_id", "may_demote")


def repository_counts(spark: SparkSession, d: str) -> DataFrame:
    return accounts.counted(table(spark, d, "nation").select("n_nationkey", "n_name"), table(spark, d, "supplier"), "n_nationkey", "s_nationkey", "n_files")


def hydrate(spark: SparkSession, d: str) -> DataFrame:
    """Line items as hits of functions (parts) of files (suppliers)."""
    hits = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.min("l_orderkey").alias("ord"), F.min("l_suppkey").alias("file_id"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("file_id"), "s_name")
    return accounts.hydrated(hits, p, s).select("id", "ord", "p_name", "s_name")


def metadata_filtered(spark: SparkSession, d: str) -> DataFrame:
    return accounts.metadata_filter(table(spark, d, "documents"), {"lang": "en", "source": ["src1", "src2"], "h1": ""}).select("doc_id", "lang", "source")


def archive_consistency(spark: SparkSession, d: str) -> DataFrame:
    return accounts.consistency(_exchange(spark, d))


def throughput(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return accounts.throughput(e, "event_type", "s")


def request_batches(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    b = accounts.request_batches(e, ["event_type"], 16, 3600.0)
    return b.groupBy("event_type", "batch").agg(F.count("*").alias("n")).groupBy("event_type").agg(F.count("*").alias("batches"), F.max("n").alias("largest"), F.sum("n").alias("requests"))


def graph_elements(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"))
    return accounts.elements(nodes, _edges(spark, d).select("caller", "callee").distinct())


def usernames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", M.username(F.concat(F.lit(" "), F.replace("c_name", F.lit("#"), F.when(F.col("c_acctbal") > 0, F.lit("_")).otherwise(F.lit("#"))), F.lit(" "))).alias("username"))


def context_lines(spark: SparkSession, d: str) -> DataFrame:
    return bm25_topk(spark, d).select("item_id", "rank", M.context_line(F.col("rank"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), F.floor(F.col("score") * 100) / 100 + 0.001).alias("line"))


def version_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", M.version_name(F.concat("source", F.lit("/x.md")), F.col("n_chars"), F.sha2("text", 256)).alias("version"))


def health_status(spark: SparkSession, d: str) -> DataFrame:
    rows = health_hysteresis(spark, d)
    last = rows.groupBy("user_id").agg(F.max_by("degraded", "event_id").alias("degraded"), F.count("*").alias("checked"))
    return last.select("user_id", M.health_status(F.col("degraded"), F.col("checked")).alias("status"))


def config_changes(spark: SparkSession, d: str) -> DataFrame:
    before, now = _snapshots(spark, d)
    b = before.select("doc_id", F.col("source").alias("bs"), F.col("digest").alias("bd"))
    return now.join(b, "doc_id").select("doc_id", M.changed([F.col("bs"), F.col("bd")], [F.col("source"), F.col("digest")]).alias("changed"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    w = windowed_counts(_events(spark, d), width="1 day")
    return w.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def exchange_append(spark: SparkSession, d: str) -> DataFrame:
    """Each question and the answer after it as an exchange, appended to what the session's system messages left."""
    m = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = m.withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w)).filter("role = 'user' and next_role = 'assistant'")
    e = pairs.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("place"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("event_id"), F.col("text").alias("question"), "answer")
    last = m.filter("role = 'system'").groupBy(F.col("conv_id").alias("session_id")).agg(F.count("*").alias("last_seq"))
    return sessions.appended(e, last).withColumn("content", F.sha2("content", 256))


def session_titles(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "conversations")
    s = m.groupBy(F.col("conv_id").alias("session_id")).agg(F.when(F.max("turn") > 4, "New chat").otherwise("Kept").alias("title"))
    first = m.filter("role = 'user'").groupBy(F.col("conv_id").alias("session_id")).agg(F.min_by("text", "turn").alias("question"))
    return sessions.titled(s, first, F.when(F.col("question").isNotNull(), T.clean_title(F.col("question"), 24)))


def requested_missing(spark: SparkSession, d: str) -> DataFrame:
    """Part keys of each order that are none of its supplier keys, and how many are."""
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("asked"), F.array_sort(F.collect_set("l_suppkey")).alias("found"))  # noqa: E741
    return l.select("l_orderkey", F.array_join(F.array_except("asked", "found"), ",").alias("missing"), F.size(F.array_intersect("asked", "found")).alias("shared"))

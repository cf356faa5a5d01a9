"""SQL that gives the rows of the queries."""

from __future__ import annotations

from ..operators import routing

_TOK = "regexp_extract_all(lower(text), '[a-z0-9_]+')"
_BM25 = f"""
d AS (SELECT doc_id, {_TOK} AS t FROM documents), dl AS (SELECT doc_id, len(t) AS dl FROM d WHERE len(t) > 0),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS token FROM d) x GROUP BY doc_id, token),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
q AS (SELECT item_id, token, count(*) AS qf FROM (SELECT item_id, unnest({_TOK}) AS token FROM benchmark) x GROUP BY item_id, token),
sc AS (SELECT q.item_id, tf.doc_id, round(sum(q.qf * ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf / (tf.tf + 1.5 * (1 - 0.75 + 0.75 * dl.dl / st.avgdl))), 9) AS score
  FROM q JOIN tf ON q.token = tf.token JOIN df ON df.token = tf.token JOIN dl ON dl.doc_id = tf.doc_id CROSS JOIN st GROUP BY q.item_id, tf.doc_id)"""
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]))"
_V = """
v0 AS (SELECT vec_id, label, list_transform(embedding, lambda x: CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 0.0::DOUBLE ELSE x::DOUBLE END) AS e FROM embeddings),
v1 AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS nrm FROM v0),
v AS (SELECT vec_id, label, CASE WHEN nrm > 0 THEN list_transform(e, lambda x: x / nrm) ELSE e END AS v FROM v1),
a AS (SELECT vec_id AS query_id, v FROM v WHERE vec_id % 100 = 0)"""
_NEAR = "SELECT a.query_id, v.vec_id, round(list_inner_product(a.v, v.v), 6) AS score FROM a CROSS JOIN v"
_LISTS = f"""{_BM25}, {_V},
bl AS (SELECT * FROM (SELECT item_id AS query_id, doc_id AS chunk_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0) x WHERE rank <= 64),
vl AS (SELECT * FROM (SELECT query_id, vec_id AS chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM
  (SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(q.v, v.v), 6) AS score FROM v q CROSS JOIN v WHERE q.vec_id IN (SELECT item_id FROM benchmark)) y) x WHERE rank <= 64),
fu AS (SELECT coalesce(vl.query_id, bl.query_id) AS query_id, coalesce(vl.chunk_id, bl.chunk_id) AS chunk_id, vl.score AS vector_score, bl.score AS bm25_score,
  round(coalesce(1 / (60.0::DOUBLE + vl.rank), 0) + coalesce(1 / (60.0::DOUBLE + bl.rank), 0), 9) AS rrf_score,
  CASE WHEN vl.rank IS NOT NULL AND bl.rank IS NOT NULL THEN 'hybrid' WHEN vl.rank IS NOT NULL THEN 'vector' ELSE 'bm25' END AS retrieval_source
  FROM vl FULL OUTER JOIN bl ON vl.query_id = bl.query_id AND vl.chunk_id = bl.chunk_id),
fr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, vector_score DESC NULLS LAST, bm25_score DESC NULLS LAST, chunk_id) AS INTEGER) AS rank FROM fu)"""
_SNAP = """
b AS (SELECT doc_id, source, sha256(text) AS digest FROM documents WHERE doc_id % 10 <> 2),
n AS (SELECT doc_id, source, CASE WHEN doc_id % 10 = 1 THEN sha256(text || '+') ELSE sha256(text) END AS digest FROM documents WHERE doc_id % 10 <> 0),
df AS (SELECT coalesce(n.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'deleted' WHEN n.source = b.source AND n.digest = b.digest THEN 'unchanged' ELSE 'modified' END AS status
  FROM n FULL OUTER JOIN b ON n.doc_id = b.doc_id)"""
_CASES = "c AS (SELECT doc_id AS id, lang, quality = 1 AS e, toxic = 0 AS p, n_chars > 500 AS o FROM labels JOIN documents USING (doc_id))"
_N = "CAST(sum(CASE WHEN {} THEN 1 ELSE 0 END) AS BIGINT)"


def _div(a: str, b: str) -> str:
    return f"round(CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / {b} END, 6)"


_TP, _FP, _FN, _TN = (_N.format(x) for x in ("e AND p", "NOT e AND p", "e AND NOT p", "NOT e AND NOT p"))
_RATES = f"count(*) AS total, {_div(f'({_TP} + {_TN})', 'count(*)')} AS accuracy, {_div(_TP, f'({_TP} + {_FP})')} AS rag_precision, {_div(_TP, f'({_TP} + {_FN})')} AS rag_recall, {_div(_TN, f'({_TN} + {_FP})')} AS direct_recall, {_FP} AS false_rag, {_FN} AS false_direct"
_EX = "x AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS event_id, conv_id AS session_id, turn AS seq, role FROM conversations)"
_STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
_H = f"h AS (SELECT conv_id, turn, role, {_STRIP.format('text')} AS content FROM conversations WHERE role IN ('user', 'assistant') AND {_STRIP.format('text')} <> '')"
_PATH = "CASE WHEN p_size % 7 = 0 THEN 'lib/tests/' WHEN p_size % 3 = 0 THEN 'lib/src/' ELSE 'lib/' END || lower(replace(p_brand, '#', '_')) || '.py'"
_CODE = f"p AS (SELECT p_partkey AS id, lower(replace(p_name, ' ', '.')) AS name, lower(p_type) AS sig, {_PATH} AS path, lower(p_name || ' ' || p_brand) AS doc, round(p_retailprice / 10000, 6) AS vs FROM part)"
_TOKENS = ["part", "brand_1", "brand", "standard", "12"]


def _hits(place: str, weight: float) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({place}, '{t}') THEN 1 ELSE 0 END" for t in _TOKENS) + f") * {weight}::DOUBLE"


_PEN = "CASE WHEN contains('/' || path, '/tests/') OR contains('/' || path, '/test/') OR contains('/' || path, '/test_') THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END"
_HOME = "CASE WHEN contains(path, '/src/') THEN {0}::DOUBLE ELSE 0.0::DOUBLE END"
_FS = f"{_hits('name', 0.16)} + {_hits('sig', 0.08)} + {_hits('path', 0.06)} + {_hits('doc', 0.04)}"
_TIMES = " + ".join(f"least(0.12::DOUBLE, 0.025::DOUBLE * ((length(doc) - length(replace(doc, '{t}', ''))) / {len(t)}))" for t in _TOKENS)
_GS = f"{_hits('path', 0.09)} + {_TIMES}"
_EDGES = "e AS (SELECT caller, callee, l_linenumber FROM (SELECT l_suppkey AS caller, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice) AS callee, l_linenumber FROM lineitem) x WHERE callee IS NOT NULL)"
_TOP = "SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM {0}) x WHERE rank <= 10"
_VTOP = "SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) x WHERE rank <= 10"

def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _phrases(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(q, {_quoted(w)})" for w in words) + ")"


def _patterns(column: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {_quoted('(?i)' + p)})" for p in patterns) + ")"


_TECH = f"regexp_matches(q, {_quoted('(?i)(^|[^A-Za-z0-9_])(' + '|'.join(routing.TECH_TERMS) + ')([^A-Za-z0-9_]|$)')})"
_PLAIN = r"regexp_replace(q, '[\s。！？!?，,、；;：:]+', '', 'g')"
_FOLLOW = f"(length(q) BETWEEN 1 AND 80 AND NOT {_TECH} AND ({_PLAIN} IN ({', '.join(map(_quoted, routing.FOLLOW_UPS))}) OR {_patterns('q', routing.FOLLOW_UP_PATTERNS)}))"
_UUID = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(source || ':' || CAST(doc_id AS VARCHAR)))"

ORACLES = {
    "keyword_route": f"""WITH c AS (SELECT conv_id, turn, lower(trim(text)) AS q, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT NULL AS b FROM conversations WHERE role = 'user'),
        r AS (SELECT conv_id, turn, CASE WHEN {_phrases(routing.FORCE_DIRECT)} THEN 'keyword_direct' WHEN {_phrases(routing.FORCE_RAG)} THEN 'keyword_rag' WHEN {_patterns('q', routing.DIRECT_TASKS)} THEN 'keyword_direct'
          WHEN {_phrases(['thehe', 'license', 'benchmark'])} THEN 'keyword_rag' WHEN {_TECH} THEN 'keyword_direct' WHEN b AND {_FOLLOW} THEN 'state_rag' ELSE 'fallback_rag' END AS route FROM c)
        SELECT conv_id, turn, route, route NOT LIKE '%direct' AS use_rag FROM r""",
    "point_ids": f"""SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || CASE substr(h, 17, 1) WHEN '0' THEN '8' WHEN '4' THEN '8' WHEN '8' THEN '8' WHEN 'c' THEN '8' WHEN '1' THEN '9' WHEN '5' THEN '9' WHEN '9' THEN '9' WHEN 'd' THEN '9'
        WHEN '2' THEN 'a' WHEN '6' THEN 'a' WHEN 'a' THEN 'a' WHEN 'e' THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM (SELECT doc_id, {_UUID} AS h FROM documents) x""",
    "public_sources": "SELECT page_id, CASE WHEN u LIKE '/%' THEN list_last(string_split(u, '/')) ELSE u END AS source FROM (SELECT page_id, replace(regexp_replace(url, '^https?:', ''), chr(92), '/') AS u FROM pages) x",
    "trim_text": f"""WITH t AS (SELECT conv_id, turn, {_STRIP.format('text')} AS t FROM conversations) SELECT conv_id, turn, CASE WHEN length(t) <= 40 THEN t ELSE {_STRIP.format('left(t, 40)')} END AS head, CASE WHEN length(t) <= 40 THEN t ELSE {_STRIP.format('right(t, 40)')} END AS tail,
        CASE WHEN length(t) <= 60 THEN t ELSE {_STRIP.format("regexp_replace(left(t, 20), '\\s+$', '') || chr(10) || '...[truncated]...' || chr(10) || regexp_replace(right(t, 21), '^\\s+', '')")} END AS middle FROM t""",
    "bm25_topk": f"WITH {_BM25} {_TOP.format('(SELECT * FROM sc WHERE score > 0) y')}",
    "bm25_filtered": f"WITH {_BM25} " + _TOP.format("(SELECT sc.* FROM sc JOIN documents USING (doc_id) WHERE score > 0 AND lang = 'en') y"),
    "bm25_stats": f"WITH {_BM25} SELECT n AS n_docs, round(avgdl, 6) AS avgdl FROM st",
    "bm25_df": f"WITH {_BM25} SELECT token, df FROM df",
    "vector_topk": f"WITH {_V}, s AS ({_NEAR}) {_VTOP}",
    "vector_threshold": f"WITH {_V}, s AS ({_NEAR}) SELECT * FROM s WHERE score >= 0.2",
    "vector_filtered": f"WITH {_V}, s AS ({_NEAR} WHERE v.label IN (1, 3, 5)) {_VTOP}",
    "vector_normalize": f"WITH {_V} SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(v[1], 6) AS first FROM v",
    "rescore_by_id": f"WITH {_V}, w AS (SELECT o_custkey AS vec_id, min(o_orderkey) AS ord FROM orders GROUP BY o_custkey) SELECT a.query_id, w.ord, v.vec_id, round(list_inner_product(a.v, v.v), 6) AS score FROM w JOIN v USING (vec_id) CROSS JOIN a",
    "hybrid_rrf": f"WITH {_LISTS} SELECT query_id, rank, 'docs' AS source, chunk_id, rrf_score, retrieval_source, round(vector_score, 6) AS vector_score, round(bm25_score, 6) AS bm25_score FROM fr WHERE rank <= 64",
    "hybrid_degraded": f"WITH {_LISTS} SELECT query_id, 'docs' AS source, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank, 'bm25' AS retrieval_source FROM bl WHERE rank <= 16",
    "rerank_batched": f"WITH {_LISTS}, r AS (SELECT query_id, chunk_id, rank, rrf_score, CAST(floor((rank - 1) / 16) AS INTEGER) AS batch, round(rrf_score * 1000 + n_chars % 97, 9) AS rerank_score FROM fr JOIN documents ON doc_id = chunk_id WHERE rank <= 64), z AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS INTEGER) AS new_rank FROM r) SELECT query_id, new_rank, chunk_id, batch, rerank_score, rrf_score FROM z WHERE new_rank <= 5",
    "anchor_route": f"""WITH {_V}, an AS (SELECT label, v FROM v WHERE label IN (0, 1)),
        s AS (SELECT v.vec_id, max(CASE WHEN an.label = 0 THEN round(list_inner_product(an.v, v.v), 6) END) AS rag_score, max(CASE WHEN an.label = 1 THEN round(list_inner_product(an.v, v.v), 6) END) AS direct_score FROM v CROSS JOIN an GROUP BY v.vec_id)
        SELECT *, CASE WHEN rag_score >= 0.2 AND round(rag_score - direct_score, 6) >= 0.02 THEN 'rag' WHEN direct_score >= 0.2 AND round(rag_score - direct_score, 6) <= -0.02 THEN 'direct' ELSE 'none' END AS route FROM s""",
    "route_confusion": f"WITH {_CASES} SELECT {_RATES} FROM c",
    "route_by_category": f"WITH {_CASES} SELECT lang, {_RATES} FROM c GROUP BY lang",
    "route_ab": f"WITH {_CASES} SELECT count(*) AS shared, {_N.format('p <> o')} AS changed, {_N.format('p <> e AND o = e')} AS fixed, {_N.format('p = e AND o <> e')} AS regressions, {_N.format('p AND NOT o AND NOT e')} AS direct_savings, {_N.format('p AND NOT o AND e')} AS rag_misses FROM c",
    "recall_mrr": f"""WITH {_BM25}, r AS (SELECT * FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0) x WHERE rank <= 10),
        g AS (SELECT item_id, doc_id FROM documents d CROSS JOIN benchmark b WHERE contains(d.text, b.text)), k AS (SELECT item_id, count(*) AS g FROM g GROUP BY item_id),
        h AS (SELECT item_id, sum(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) AS h, min(rank) AS f FROM r JOIN g USING (item_id, doc_id) GROUP BY item_id)
        SELECT count(*) AS n_queries, round(coalesce(avg(coalesce(h, 0) / g), 0.0), 6) AS recall_at_k, round(coalesce(avg(coalesce(h, 0) / 5), 0.0), 6) AS precision_at_k, round(coalesce(avg(coalesce(1 / f, 0.0)), 0.0), 6) AS mrr FROM k LEFT JOIN h USING (item_id)""",
    "latency_percentiles": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS avg, round(min(value), 6) AS min, round(max(value), 6) AS max, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type",
    "latency_slope": "SELECT event_type, round(coalesce(regr_slope(value, event_id), 0.0), 6) AS slope FROM events GROUP BY event_type",
    "latency_index_percentile": "SELECT event_type, round(max(CASE WHEN i = least(CAST(floor(n * 0.95) AS BIGINT), n - 1) THEN value END), 6) AS p, round(median(value), 6) AS median FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) x GROUP BY event_type",
    "top_sources": "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5",
    "health_hysteresis": """WITH p AS (SELECT event_id, user_id, event_type <> 'error' AS ok, lag(event_type <> 'error') OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM events),
        s AS (SELECT event_id, user_id, ok, CASE WHEN NOT ok AND NOT last THEN 1 WHEN ok AND last THEN 0 END AS g FROM p),
        k AS (SELECT *, count(g) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS grp FROM s)
        SELECT event_id, user_id, ok, coalesce(max(g) OVER (PARTITION BY user_id, grp), 0) = 1 AS degraded FROM k""",
    "manifest_diff": f"WITH {_SNAP} SELECT * FROM df",
    "manifest_counts": f"WITH {_SNAP} SELECT status, count(*) AS n FROM df GROUP BY status",
    "sync_plan": f"WITH {_SNAP} SELECT doc_id, CASE status WHEN 'added' THEN 'upload' WHEN 'deleted' THEN 'delete' WHEN 'unchanged' THEN 'skip' ELSE 'upload' END AS action FROM df",
    "copy_unchanged": f"WITH {_SNAP} SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM df WHERE status = 'unchanged')",
    "index_changed": f"WITH {_SNAP} SELECT * FROM n WHERE doc_id IN (SELECT doc_id FROM df WHERE status IN ('added', 'modified'))",
    "version_retention": """WITH r AS (SELECT user_id AS key, event_id AS version, event_type = 'error' AS deleted, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events),
        u AS (SELECT key, min(CASE WHEN NOT deleted THEN r END) AS u FROM r GROUP BY key)
        SELECT key, version, deleted, CASE WHEN coalesce(u > 2, false) THEN r < 2 OR r = u ELSE r <= 2 END AS kept FROM r JOIN u USING (key)""",
    "collection_retention": "SELECT name, name = 'Customer#000000001' OR r <= 4 AS kept FROM (SELECT c_name AS name, row_number() OVER (PARTITION BY c_name = 'Customer#000000001' ORDER BY c_name DESC) AS r FROM customer) x",
    "content_fingerprint": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "signature": """WITH d AS (SELECT sha256(concat_ws('|', CAST(doc_id AS VARCHAR), source, CAST(n_chars AS VARCHAR))) AS d FROM documents),
        p AS (SELECT substr(d, 1, 3) AS p, sha256(string_agg(d, '|' ORDER BY d)) AS d FROM d GROUP BY substr(d, 1, 3)) SELECT sha256(string_agg(d, '|' ORDER BY p)) AS fingerprint FROM p""",
    "user_counts": "SELECT c_custkey, c_name, count(DISTINCT o_orderkey) AS session_count, count(l_orderkey) AS message_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY c_custkey, c_name",
    "seq_backfill": """WITH m AS (SELECT conv_id, turn, CASE WHEN role <> 'assistant' THEN turn + 1 END AS seq FROM conversations), k AS (SELECT conv_id, max(seq) AS m FROM m WHERE seq IS NOT NULL GROUP BY conv_id)
        SELECT * FROM m WHERE seq IS NOT NULL UNION ALL SELECT m.conv_id, m.turn, row_number() OVER (PARTITION BY m.conv_id ORDER BY m.turn) + coalesce(k.m, 0) AS seq FROM m LEFT JOIN k ON m.conv_id = k.conv_id WHERE m.seq IS NULL""",
    "max_seq": "SELECT conv_id, max(turn) AS max_seq, count(*) AS n_messages FROM conversations GROUP BY conv_id",
    "session_list": "SELECT o_custkey, CAST(place AS INTEGER) AS place, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders) x WHERE place <= 50",
    "message_list": "SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role <> 'system' THEN turn END NULLS LAST, turn) AS INTEGER) AS place FROM conversations",
    "prompt_history": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) x WHERE r > 2",
    "history_recent": f"WITH {_H}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM h) SELECT conv_id, string_agg(upper(role) || ': ' || content, chr(10) || chr(10) ORDER BY turn) AS history FROM r WHERE r <= 4 GROUP BY conv_id",
    "last_user_two": f"WITH {_H}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM h WHERE role = 'user'), q AS (SELECT conv_id, {_STRIP.format('string_agg(content, chr(10) ORDER BY turn)')} AS q FROM r WHERE r <= 2 GROUP BY conv_id) SELECT conv_id, CASE WHEN length(q) <= 300 THEN q ELSE {_STRIP.format('right(q, 300)')} END AS search_query FROM q",
    "previous_route": f"""WITH {_H}, a AS (SELECT conv_id, max(turn) AS t FROM h WHERE role = 'assistant' GROUP BY conv_id), u AS (SELECT h.conv_id, max(h.turn) AS t FROM h JOIN a ON h.conv_id = a.conv_id AND h.turn < a.t WHERE h.role = 'user' GROUP BY h.conv_id)
        SELECT a.conv_id, a.t AS assistant_turn, CASE WHEN length(x.content) <= 60 THEN x.content ELSE {_STRIP.format('left(x.content, 60)')} END AS excerpt, coalesce(y.content, '') AS user_text FROM a JOIN h x ON x.conv_id = a.conv_id AND x.turn = a.t LEFT JOIN u ON u.conv_id = a.conv_id LEFT JOIN h y ON y.conv_id = u.conv_id AND y.turn = u.t""",
    "token_estimate": "SELECT conv_id, turn, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM conversations",
    "compaction": f"WITH {_H}, f AS (SELECT conv_id, count(*) AS n, CAST(ceil(length(string_agg(upper(role) || ': ' || content, chr(10) || chr(10) ORDER BY turn)) / 4) AS BIGINT) AS history_tokens FROM h GROUP BY conv_id) SELECT conv_id, history_tokens, history_tokens > 100 AND n > 4 AS compact, CAST(CASE WHEN history_tokens > 100 AND n > 4 THEN n - 4 ELSE 0 END AS BIGINT) AS n_compacted FROM f",
    "clean_titles": r"SELECT conv_id, turn, CASE WHEN t = '' THEN 'New chat' ELSE regexp_replace(left(t, 24), '\s+$', '') END AS title FROM (SELECT conv_id, turn, " + _STRIP.format(r"regexp_replace(text, '\s+', ' ', 'g')") + " AS t FROM conversations) x",
    "archive_idempotent": f"WITH {_EX} SELECT * FROM x WHERE role IN ('user', 'assistant', 'system')",
    "archive_sessions": "SELECT conv_id AS session_id, greatest(1, max(turn)) AS archive_seq FROM conversations GROUP BY conv_id",
    "pending_overlay": f"WITH {_EX} SELECT event_id, session_id, seq, CASE WHEN seq < 4 THEN role ELSE 'pending-' || role END AS role FROM x",
    "role_merge": """WITH m AS (SELECT conv_id, turn, role, text, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS c FROM conversations WHERE role <> 'system'),
        r AS (SELECT *, CAST(sum(c) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM m) SELECT conv_id, run, role, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS content_hash FROM r GROUP BY conv_id, run, role""",
    "upsert_nothing": "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_name ELSE 'new' END AS c_name, c_acctbal FROM customer",
    "upsert_update": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'changed' ELSE c_name END AS c_name, c_acctbal FROM customer",
    "cascade_delete": """WITH c AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
        SELECT 'customer' AS table_name, count(*) AS n FROM customer WHERE NOT c_acctbal < 0 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM c) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o)""",
    "constraint_checks": """SELECT 'unique conv_id,turn' AS rule, count(*) AS n FROM (SELECT conv_id, turn FROM conversations GROUP BY conv_id, turn HAVING count(*) > 1) x UNION ALL SELECT 'unique text', count(*) FROM (SELECT text FROM conversations GROUP BY text HAVING count(*) > 1) x
        UNION ALL SELECT 'check role', count(*) FROM conversations WHERE role NOT IN ('user', 'assistant') UNION ALL SELECT 'check text', count(*) FROM conversations WHERE NOT length(text) > 0""",
    "code_text_score": f"WITH {_CODE}, s AS (SELECT *, {_FS} AS s FROM p), t AS (SELECT id, round(greatest(0.0, CASE WHEN s > 0 THEN s + {_HOME.format(0.04)} ELSE 0.0 END - {_PEN}), 6) AS s FROM s) SELECT id, round(0.75 + s, 6) AS score FROM t WHERE s > 0",
    "file_text_score": f"WITH {_CODE}, s AS (SELECT *, {_GS} AS s FROM p), t AS (SELECT id, round(greatest(0.0, CASE WHEN s > 0 THEN s + {_HOME.format(0.04)} ELSE 0.0 END - {_PEN}), 6) AS s FROM s) SELECT id, round(0.75 + s, 6) AS score FROM t WHERE s > 0",
    "code_rank": f"WITH {_CODE}, s AS (SELECT *, {_PEN} > 0 AS pen, round({_hits('name', 0.09)} + {_hits('sig', 0.04)} + {_hits('path', 0.03)} + {_hits('doc', 0.02)} + {_HOME.format(0.025)} - {_PEN}, 6) AS b FROM p), t AS (SELECT *, round(vs + b, 6) AS final_score FROM s), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY final_score DESC, vs DESC, pen, id) AS INTEGER) AS rank FROM t) SELECT path, rank, id, final_score FROM r WHERE rank <= 3",
    "call_chain": f"WITH RECURSIVE {_EDGES}, g(id, depth) AS (SELECT * FROM (VALUES (1::BIGINT, 0), (5::BIGINT, 0)) t UNION SELECT e.callee, g.depth + 1 FROM g JOIN e ON g.id = e.caller WHERE g.depth < 3) SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM g GROUP BY id",
    "callers": f"WITH {_EDGES} SELECT DISTINCT caller AS id FROM e WHERE callee IN (5, 9)",
    "neighbours": f"""WITH {_EDGES}, u AS (SELECT DISTINCT caller, callee FROM e), dg AS (SELECT id, count(*) AS degree FROM (SELECT caller AS id FROM u UNION ALL SELECT callee FROM u) x GROUP BY id),
        b AS (SELECT DISTINCT id, nb FROM (SELECT caller AS id, callee AS nb FROM u UNION ALL SELECT callee, caller FROM u) x), sp AS (SELECT DISTINCT s_nationkey FROM supplier WHERE s_suppkey IN (1, 5)),
        r AS (SELECT b.id, b.nb AS neighbour, CAST(row_number() OVER (PARTITION BY b.id ORDER BY CASE WHEN s.s_nationkey IN (SELECT s_nationkey FROM sp) THEN 0 ELSE 1 END, degree DESC, s_name) AS INTEGER) AS rank FROM b JOIN supplier s ON s.s_suppkey = b.nb LEFT JOIN dg ON dg.id = b.nb) SELECT * FROM r WHERE rank <= 4""",
    "edge_lines": f"WITH {_EDGES} SELECT caller, callee, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS lines FROM (SELECT DISTINCT * FROM e) x GROUP BY caller, callee",
    "auth_sessions": "SELECT o_orderkey AS token_id, c_custkey AS user_id, c_name AS username FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate > TIMESTAMP '1996-01-01' AND c_acctbal > 0",
    "expired_sessions": "SELECT o_orderkey AS token_id FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01'",
    "demotable": "SELECT c_custkey AS user_id, c_custkey <> 1 AND (NOT (c_mktsegment = 'BUILDING' AND c_acctbal > 0) OR (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0) > 1) AS may_demote FROM customer",
    "repository_counts": "SELECT n_nationkey, n_name, count(s_suppkey) AS n_files FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_nationkey, n_name",
    "hydrate": "SELECT p_partkey AS id, ord, p_name, s_name FROM (SELECT l_partkey, min(l_orderkey) AS ord, min(l_suppkey) AS f FROM lineitem GROUP BY l_partkey) x JOIN part ON l_partkey = p_partkey JOIN supplier ON f = s_suppkey",
    "metadata_filtered": "SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2')",
    "archive_consistency": f"WITH {_EX} SELECT session_id, count(*) AS n_messages, count(DISTINCT event_id) AS n_events, count(*) = count(DISTINCT seq) AND max(seq) - min(seq) + 1 = count(DISTINCT seq) AS whole FROM x GROUP BY session_id",
    "throughput": "SELECT event_type, count(*) AS n, round(coalesce(count(*) / nullif(epoch(max(ts)) - epoch(min(ts)), 0), 0.0), 6) AS qps FROM events GROUP BY event_type",
    "graph_elements": f"WITH {_EDGES} SELECT 'node' AS \"group\", CAST(s_suppkey AS VARCHAR) AS id, s_name AS label, NULL AS source, NULL AS target FROM supplier UNION ALL SELECT DISTINCT 'edge', CAST(caller AS VARCHAR) || '->' || CAST(callee AS VARCHAR), NULL, CAST(caller AS VARCHAR), CAST(callee AS VARCHAR) FROM e",
    "usernames": "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN lower(replace(c_name, '#', '_')) WHEN contains(c_name, '#') THEN NULL ELSE lower(c_name) END AS username FROM customer",
    "context_lines": f"WITH {_BM25}, t AS ({_TOP.format('(SELECT * FROM sc WHERE score > 0) y')}) SELECT item_id, rank, printf('[%d] source=doc-%d score=%.4f', rank, doc_id, floor(score * 100) / 100 + 0.001) AS line FROM t",
    "version_names": "SELECT doc_id, regexp_replace(source || '/x.md', '[^a-zA-Z0-9_]+', '_', 'g') || '__v' || CAST(n_chars AS VARCHAR) || '_' || substr(sha256(text), 1, 12) AS version FROM documents",
    "config_changes": f"WITH {_SNAP} SELECT n.doc_id, NOT (n.source = b.source AND n.digest = b.digest) AS changed FROM n JOIN b ON n.doc_id = b.doc_id",
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY strftime(ts, '%Y-%m-%d'), event_type",
    "exchange_append": """WITH m AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nt FROM conversations),
        p AS (SELECT conv_id, turn, text, nt, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM m WHERE role = 'user' AND nr = 'assistant'),
        l AS (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'system' GROUP BY conv_id),
        s AS (SELECT p.*, CAST(coalesce(l.n, 0) + 2 * (k - 1) AS BIGINT) AS s FROM p LEFT JOIN l ON p.conv_id = l.conv_id)
        SELECT conv_id AS session_id, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS event_id, s + 1 AS seq, 'user' AS role, sha256(text) AS content FROM s
        UNION ALL SELECT conv_id, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), s + 2, 'assistant', sha256(nt) FROM s""",
    "session_titles": r"WITH q AS (SELECT conv_id, text FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'user') x WHERE r = 1), t AS (SELECT conv_id, " + _STRIP.format(r"regexp_replace(text, '\s+', ' ', 'g')") + r" AS t FROM q), s AS (SELECT conv_id, max(turn) > 4 AS fresh FROM conversations GROUP BY conv_id) SELECT s.conv_id AS session_id, CASE WHEN NOT fresh THEN 'Kept' WHEN t IS NULL OR t = '' THEN 'New chat' ELSE regexp_replace(left(t, 24), '\s+$', '') END AS title FROM s LEFT JOIN t ON s.conv_id = t.conv_id",
    "requested_missing": "WITH a AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), f AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT a.l_orderkey, coalesce(string_agg(CASE WHEN f.l_suppkey IS NULL THEN CAST(a.l_partkey AS VARCHAR) END, ',' ORDER BY a.l_partkey), '') AS missing, CAST(count(f.l_suppkey) AS INTEGER) AS shared FROM a LEFT JOIN f ON a.l_orderkey = f.l_orderkey AND a.l_partkey = f.l_suppkey GROUP BY a.l_orderkey",
}

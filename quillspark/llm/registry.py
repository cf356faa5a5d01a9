"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import hilbert, mixing, nbest_pieces, packing, prefix_trie, rule_ensemble, runs, shingle_join, suffix_dedup, token_files, topk, warc_audit, weak_rules

QUERIES = {
    "op1_hilbert_shards": hilbert.query,
    "op2_rule_ensemble": rule_ensemble.query,
    "op3_suffix_dedup": suffix_dedup.query,
    "op4_nbest_pieces": nbest_pieces.query,
    "op5_entropy_mix": mixing.query,
    "op6_shingle_join": shingle_join.query,
    "op7_weak_rules": weak_rules.query,
    "op8_warc_audit": warc_audit.query,
    "op9_token_parquet": token_files.query,
    "op10_norm_topk": topk.query,
    "op11_periodic_runs": runs.query,
    "op12_binary_packing": packing.query,
    "op13_prefix_trie": prefix_trie.query,
}

ORACLES = {
    "op8_warc_audit": warc_audit.ORACLE,
    "op10_norm_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
}

"""Queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import more, queries
from .oracles import ORACLES as _ORACLES

_NAMES = """
bm25_topk bm25_filtered bm25_stats bm25_df vector_topk vector_threshold vector_filtered vector_normalize rescore_by_id hybrid_rrf hybrid_degraded rerank_batched anchor_route keyword_route
route_confusion route_by_category route_ab recall_mrr latency_percentiles latency_slope latency_index_percentile top_sources health_hysteresis manifest_diff manifest_counts sync_plan copy_unchanged
index_changed version_retention collection_retention content_fingerprint signature point_ids user_counts seq_backfill max_seq session_list message_list prompt_history history_recent last_user_two
previous_route token_estimate compaction trim_text clean_titles archive_idempotent archive_sessions pending_overlay role_merge upsert_nothing upsert_update cascade_delete constraint_checks
sentence_split clause_split chunk_docs chunk_overlap code_text_score file_text_score code_rank call_chain callers neighbours edge_lines public_sources
auth_sessions expired_sessions demotable repository_counts hydrate metadata_filtered archive_consistency throughput request_batches graph_elements usernames context_lines version_names health_status config_changes event_windows exchange_append session_titles requested_missing
""".split()

QUERIES = {n: getattr(queries, n) for n in _NAMES} | more.QUERIES
ORACLES = _ORACLES | more.SQL

__all__ = ["ORACLES", "QUERIES"]

"""Times of headline queries: one JSON line. BENCH_SF_DIR: tables; BENCH_CPUS: threads."""

from __future__ import annotations

import json
import os
import time

from quillspark.plans import registry
from quillspark.session import session

QUERIES = ["bm25_topk", "vector_topk", "hybrid_rrf", "rerank_batched", "manifest_diff", "user_counts", "health_hysteresis", "latency_percentiles", "archive_idempotent", "chunk_overlap", "sentence_split", "call_chain", "content_fingerprint"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus, int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["content_fingerprint"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the engine
    times = {}
    for name in QUERIES:
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

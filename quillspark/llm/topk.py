"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are put in order of falling length and cut into blocks, and each block into buckets. A query goes through the
buckets with the k-th best score so far: where that score divided by both lengths is above one, the bucket is skipped
(length pruning); where it is high, only vectors whose coordinates lie in the range that such a cosine admits are kept
(coordinate pruning); the rest are cut where their length gets too short. What remains is verified by exact integer
products. A first pass over the block of the longest vectors gives every query its starting score. Queries go out in chunks of a
bounded size that every task gets; vectors stay where they are, and blocks that are too short for all queries of a chunk are
not read.

Null vectors and vectors with null or non-finite components take no part. Vectors of different lengths count as padded with
zeros. A query does not meet rows of its own id. Ties go to the smaller id, repeated rows count singly, and an empty
table gives no rows. Scores beyond 64 bits are held at the ends of that range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop, ordered, table, tidy

BLOCK = 8192
BUCKET = 512
#: Bytes of query vectors that are broadcast at once.
CHUNK = 32 << 20
#: From this cosine on, coordinates prune better than lengths.
COSINE = 0.7


def _pack(rows: DataFrame, dims: int) -> DataFrame:
    """One row for each run of equal `_block` (in order): greatest length, ids and a matrix of 64-bit components as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            ids, m = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            top = float(np.sqrt((m * m).sum(1)).max())
            return pa.RecordBatch.from_arrays([pa.array([held[0][0]], "int64"), pa.array([top]), pa.array([ids.tobytes()], "binary"), pa.array([m.tobytes()], "binary")], names=["block", "top", "ids", "matrix"])

        for b in batches:
            keys, ids, m = b.column("_block").to_numpy(), b.column("vec_id").to_numpy(), matrix(b.column("v"), dims)
            edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]) if len(keys) else []
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if held and held[0][0] != keys[s]:
                    yield out()
                    held.clear()
                held.append((int(keys[s]), ids[s:e], m[s:e]))
        if held:
            yield out()

    return rows.mapInArrow(tidy(pack), "block long, top double, ids binary, matrix binary")


def matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """Vectors as rows, shorter ones padded with zeros."""
    m = np.zeros((len(lists), dims))
    bounds = lists.offsets.to_numpy()
    lengths = np.diff(bounds)
    at = np.repeat(np.arange(len(lists)), lengths), np.arange(bounds[0], bounds[-1]) - np.repeat(bounds[:-1], lengths)
    m[at] = lists.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]]
    return m


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of whole-numbered doubles."""
    bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[-1]
    if bound < 2**53:
        return (a @ b).astype("int64")
    whole = lambda x: np.vectorize(int, otypes=[object])(x) if x.size else x.astype(object)
    exact = whole(a) @ whole(b)
    return np.clip(exact, -(2**63), 2**63 - 1).astype("int64")


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of up to k candidates each; floor: scores that k other rows are known to reach."""
    norms = np.sqrt((vectors * vectors).sum(1))
    order = np.lexsort((ids, -norms))
    ids, vectors, norms = ids[order], vectors[order], norms[order]
    unit = vectors / np.maximum(norms, 1e-300)[:, None]
    lengths = np.sqrt((queries * queries).sum(1))
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    for i, (q, length) in enumerate(zip(queries, lengths, strict=True)):
        best_ids, best = np.empty(0, "int64"), np.empty(0, "int64")
        least = float(floor[i])
        direction = q / max(length, 1e-300)
        focus = np.argsort(-np.abs(direction))[:3]
        for s in range(0, len(ids), BUCKET):
            e = min(s + BUCKET, len(ids))
            reach = length * norms[s] * (1 + 1e-9) + 1e-6
            if least > reach:
                break  # lengths only fall from here
            local = least / reach if reach > 0 else -1.0
            if local >= COSINE:
                d = direction[focus]
                slack = np.sqrt(np.maximum(0, (1 - d**2) * (1 - local**2))) + 1e-9
                near = unit[s:e][:, focus]
                some = s + np.flatnonzero((((near >= d * local - slack) | (d <= -local)) & ((near <= d * local + slack) | (d >= local))).all(1))
            else:
                some = np.arange(s, s + int(np.searchsorted(-norms[s:e], -(least - 1e-6) / (length * (1 + 1e-9)), side="right"))) if least > 0 and length > 0 else np.arange(s, e)
            some = some[ids[some] != query_ids[i]]
            if not len(some):
                continue
            score = products(vectors[some], q)
            good = score >= least
            best_ids, best = np.r_[best_ids, ids[some][good]], np.r_[best, score[good]]
            if len(best) > k:
                top = np.lexsort((best_ids, -best))[:k]
                best_ids, best = best_ids[top], best[top]
            if len(best) == k:
                least = max(least, float(best.min()))
        found.append((int(query_ids[i]), best_ids, best))
    return found


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score. Both inputs: vec_id and v, an array of whole-numbered doubles."""
    spark = vectors.sparkSession
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).first()
    dims, blocks = size["dims"] or 1, max(1, -(-size["n"] // BLOCK))
    sorted_ = ordered(vectors.select("vec_id", "v", norm.alias("norm")), [F.desc("norm"), F.col("vec_id")], blocks)
    # A part that became longer than a block is cut again, so that no packed row grows.
    block = F.shiftleft(F.col("_part").cast("long"), 32) + F.floor(F.col("_pos") / BLOCK)
    data = cut(_pack(sorted_.withColumn("_block", block).repartitionById(blocks, F.col("_part")).sortWithinPartitions("_block", "_pos"), dims))
    drop(sorted_)
    longest = data.agg(F.min("block").alias("b")).first()["b"]
    chunks = max(1, -(-queries.count() * dims * 8 // CHUNK))
    dealt = cut(queries.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int").alias("chunk")).repartition(chunks, "chunk"))
    found = [_asked(data, dealt.filter(F.col("chunk") == c), dims, k, longest) for c in range(chunks)]  # each within CHUNK bytes or so
    drop(data, dealt)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _asked(data: DataFrame, queries: DataFrame, dims: int, k: int, longest: int | None) -> DataFrame:
    """The results of one chunk of queries, as a scratch table."""
    spark = data.sparkSession
    rows = queries.select("vec_id", "v").toArrow().combine_chunks()
    ids = rows.column("vec_id").to_numpy()
    asked = matrix(rows.column("v").combine_chunks(), dims) if len(ids) else np.zeros((0, dims))
    lengths = np.sqrt((asked * asked).sum(1))

    def run(blocks: DataFrame, floor: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast((ids, asked, floor))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, vectors, least = sent.value
            least = least.copy()  # rises with what this task finds
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for b in batches:
                for own, top, m in zip(b.column("ids"), b.column("top").to_pylist(), b.column("matrix"), strict=True):
                    near = np.flatnonzero(least <= lengths * top * (1 + 1e-9) + 1e-6)
                    own, m = np.frombuffer(own.as_buffer(), "int64"), np.frombuffer(m.as_buffer()).reshape(-1, dims)
                    for i, (_, some, scores) in zip(near.tolist(), search(own, m, query_ids[near], vectors[near], k, least[near]), strict=True):
                        if not len(some):
                            continue
                        if i in best:
                            some, scores = np.r_[best[i][0], some], np.r_[best[i][1], scores]
                        order = np.lexsort((some, -scores))[:k]
                        best[i] = some[order], scores[order]
                        if len(order) == k:
                            least[i] = max(least[i], float(scores[order].min()))
            n = [len(x[0]) for x in best.values()]
            asked_by = np.repeat(query_ids[list(best)], n) if best else np.empty(0, "int64")
            columns = [asked_by, *(np.concatenate([x[c] for x in best.values()]) if best else np.empty(0, "int64") for c in (0, 1))]
            for at in range(0, len(asked_by), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 10_000], "int64") for c in columns], names=["query_id", "vec_id", "score"])

        return blocks.mapInArrow(tidy(each), "query_id long, vec_id long, score long")

    floor = np.full(len(ids), -np.inf)
    if longest is not None:
        first = run(data.filter(F.col("block") == longest), floor).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
        known = {r["query_id"]: r["least"] for r in first.filter(F.col("n") >= k).collect()}  # a row for each query of the chunk
        floor = np.array([known.get(q, -np.inf) for q in ids.tolist()])
    # The shortest vector that could still score for some query, where all scores to beat are above zero.
    reach = float(np.min(np.where(floor > 0, (floor - 1e-6) / np.maximum(lengths, 1e-300), 0.0) * (1 - 1e-9), initial=np.inf)) if len(ids) else 0.0
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows a task
    ranked = run(data.filter(F.col("top") >= reach), floor).withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
    return cut(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def quantised(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == F.lit(float("inf"))))
    return embeddings.filter(x.isNotNull() & F.col("vec_id").isNotNull()).filter(~bad).select("vec_id", F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("double")).alias("v"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(v, v.filter(F.col("vec_id") % 100 == 0), 10)

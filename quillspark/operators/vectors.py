"""Vectors: cleaning, products, cosine top-k, anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of questions that are sent to every task at once.
SENT = 32 << 20


def finite(v: Column) -> Column:
    x = lambda e: F.when(e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")), F.lit(0.0)).otherwise(e)
    return F.transform(v, lambda e: x(e.cast("double")))


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 for empty vectors."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _once(value: Column, of) -> Column:
    """of(value), where value is computed once however often `of` names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def normalized(v: Column) -> Column:
    return _once(v, lambda w: _once(F.sqrt(dot(w, w)), lambda n: F.when(n > 0, F.transform(w, lambda x: x / n)).otherwise(w)))


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """Vectors as rows; shorter ones count as padded with zeros, longer ones up to dims."""
    bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("float64", copy=False)
    sizes = np.minimum(np.diff(bounds), dims)
    out = np.zeros((len(lists), dims))
    row = np.repeat(np.arange(len(lists)), sizes)
    column = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, column] = flat[bounds[:-1][row] + column]
    return out


def nearest(vectors: DataFrame, questions: DataFrame, threshold: float = 0.0, k: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, vec_id, score) of each question against each vector; null vectors take no part. Vectors stay where they are.

    Questions go to all tasks as a matrix, as many at once as SENT bytes hold; more than these take more passes over the
    vectors. vectors: vec_id, v; questions: query_id, v. A threshold over 0 keeps scores that reach it. With k, no more than the k
    best of each batch of vectors (ties by vec_id) leave a task, so that few rows are ranked. allowed: (query_id, grp), in which case
    vectors have a `grp` too and a question meets only those of its groups.
    """
    asked = questions.select("query_id", F.col("v").cast("array<double>").alias("v"))
    size = asked.agg(F.max(F.size("v")).alias("dims"), F.sum(F.size("v")).alias("x")).first()
    dims, passes = size["dims"] or 1, max(1, -(-8 * (size["x"] or 0) // SENT))
    kinds = dict(vectors.dtypes) | dict(questions.dtypes)
    rows, out = vectors.select("vec_id", F.col("v").cast("array<double>").alias("v"), *(["grp"] if allowed is not None else [])), None
    for number in range(passes):
        some = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == number).toArrow().drop_null().combine_chunks()
        ids = some.column("query_id").combine_chunks()
        matrix = _matrix(some.column("v").combine_chunks(), dims) if len(ids) else np.zeros((0, dims))
        groups: dict = {}
        grouped = allowed is not None
        if grouped:
            place = {q: i for i, q in enumerate(ids.to_pylist())}
            for r in allowed.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == number).collect():  # some groups for each question of the pass
                if r["query_id"] in place:
                    groups.setdefault(r["grp"], []).append(place[r["query_id"]])

        def run(batches: Iterator[pa.RecordBatch], ids: pa.Array = ids, matrix: np.ndarray = matrix, groups: dict = groups) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 4096):
                    b = whole.slice(at, 4096).drop_null()
                    own = _matrix(b.column("v"), dims)
                    met = np.zeros((len(ids), b.num_rows), bool) if grouped else None
                    for i, g in enumerate(b.column("grp").to_pylist() if met is not None else []):
                        met[groups.get(g, []), i] = True
                    for first in range(0, len(ids), 256):
                        scores = np.round(matrix[first : first + 256] @ own.T, 6) + 0.0
                        keep = scores >= threshold if threshold > 0 else np.ones(scores.shape, bool)
                        if met is not None:
                            keep &= met[first : first + 256]
                            scores = np.where(keep, scores, -np.inf)
                        if k is not None and k < scores.shape[1]:
                            keep &= scores >= -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]  # ties of the k-th stay; the ranking settles them
                        asked_by, found = np.nonzero(keep)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(asked_by + first)), b.column("vec_id").take(pa.array(found)), pa.array(scores[asked_by, found])], names=["query_id", "vec_id", "score"])

        one = rows.mapInArrow(run, f"query_id {kinds['query_id']}, vec_id {kinds['vec_id']}, score double")
        out = one if out is None else out.unionByName(one)
    return out


def highest(vectors: DataFrame, anchors: DataFrame) -> DataFrame:
    """(vec_id, score): the score of each vector with the nearest anchor, one row a vector. Without anchors there are no rows.

    Anchors go to all tasks, as many at once as SENT bytes hold. vectors: vec_id, v; anchors: anchor_id, v.
    """
    sent = anchors.select("anchor_id", F.col("v").cast("array<double>").alias("v")).filter("v is not null")
    size = sent.agg(F.max(F.size("v")).alias("dims"), F.sum(F.size("v")).alias("x")).first()
    dims, passes = size["dims"] or 1, max(1, -(-8 * (size["x"] or 0) // SENT))
    rows, out = vectors.select("vec_id", F.col("v").cast("array<double>").alias("v")), None
    for number in range(passes):
        some = sent.filter(F.pmod(F.xxhash64("anchor_id"), F.lit(passes)) == number).select("v").toArrow().column("v").combine_chunks()
        matrix = _matrix(some, dims) if len(some) else np.zeros((0, dims))

        def run(batches: Iterator[pa.RecordBatch], matrix: np.ndarray = matrix) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 4096):
                    b = whole.slice(at, 4096).drop_null()
                    if b.num_rows and len(matrix):
                        own, best = _matrix(b.column("v"), dims), np.full(b.num_rows, -np.inf)
                        for first in range(0, len(matrix), 256):
                            best = np.maximum(best, (matrix[first : first + 256] @ own.T).max(0))
                        yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(np.round(best, 6) + 0.0)], names=["vec_id", "score"])

        one = rows.mapInArrow(run, f"vec_id {dict(vectors.dtypes)['vec_id']}, score double")
        out = one if out is None else out.unionByName(one)
    return out if passes == 1 else out.groupBy("vec_id").agg(F.max("score").alias("score"))


def rescored(pairs: DataFrame, vectors: DataFrame, question: DataFrame) -> DataFrame:
    """(query_id, ord, vec_id, score) of wanted ids in their order; repeats keep the first place, unknown ids go."""
    wanted = pairs.groupBy("query_id", "vec_id").agg(F.min("ord").alias("ord"))
    return wanted.join(vectors, "vec_id").join(question.select("query_id", F.col("v").alias("q")), "query_id").select("query_id", "ord", "vec_id", F.round(dot(F.col("q"), F.col("v")), 6).alias("score"))


def anchor_route(rows: DataFrame, rag: DataFrame, direct: DataFrame, rag_least: float = 0.38, direct_least: float = 0.40, margin: float = 0.06) -> DataFrame:
    """The route that the nearer of two anchor sets suggests. rows: vec_id, v; anchors: anchor_id, v."""
    most = lambda anchors, name: highest(rows, anchors).withColumnRenamed("score", name)
    both = most(rag, "rag_score").join(most(direct, "direct_score"), "vec_id")
    gap = F.round(F.col("rag_score") - F.col("direct_score"), 6)
    route = F.when((F.col("rag_score") >= rag_least) & (gap >= margin), "rag").when((F.col("direct_score") >= direct_least) & (gap <= -margin), "direct").otherwise("none")
    return both.withColumn("route", route)

"""A stored collection of vectors: cells of near vectors, exact search that skips cells, filters, scrolling.

Vectors are dealt to the nearest of some centroids (k-means over all of them; each task sends sums by cell) and stored in a folder for each cell. A
search scores each question in the cells around it first, until k rows are met. From then on, by the triangle inequality, a cell
whose border is farther from a question than its k-th best row holds nothing for it, and folders that no question needs are not read. Inside a
cell, rows are left out likewise by their distances from the centroid. Results are those of a search through all rows; how many cells are
spared depends on how clustered the vectors are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..sources.scratch import stored
from ..sources.snapshots import Snapshots
from .lexical import top
from .vectors import SENT, _matrix, finite, normalized

#: Most cells, so that centroids fit in a task, and folders in a listing.
MOST_CELLS = 4096
ROUNDS = 4
#: Scores are rounded to so many digits; bounds give way by that much.
DIGITS, SLACK = 6, 2e-6


def _centroids(vectors: DataFrame, k: int, rounds: int) -> np.ndarray:
    """k centroids of vectors (vec_id, v: unit vectors) by Lloyd's rounds from the k rows of least hash; cells that lose all rows keep their centroid."""
    first = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(k).select("v").toArrow().column("v").combine_chunks()
    dims = len(first[0])
    now = _matrix(first, dims)
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(now.shape), np.zeros(len(now), "int64")
            for b in batches:
                own = _matrix(b.column("v"), dims)
                cell = _nearest(own, now)[0]
                np.add.at(total, cell, own)
                n += np.bincount(cell, minlength=len(now))
            some = np.flatnonzero(n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype="int32") * dims), pa.array(total[some].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), lists], names=["cell", "n", "s"])

        parts = vectors.select("v").mapInArrow(sums, "cell long, n long, s array<double>")
        found = parts.groupBy("cell").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s")).collect()  # a row for each cell
        now = now.copy()
        for r in found:
            now[r["cell"]] = np.array(r["s"]) / r["n"]
    return now


def _nearest(own: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and its distance."""
    cell, far = np.zeros(len(own), "int64"), np.zeros(len(own))
    for at in range(0, len(own), 1024):
        some = own[at : at + 1024]
        squares = (centroids**2).sum(1) - 2 * some @ centroids.T
        cell[at : at + 1024] = c = squares.argmin(1)
        far[at : at + 1024] = np.sqrt(((some - centroids[c]) ** 2).sum(1))
    return cell, far


class VectorCollection:
    """Versions of a collection in a store. key: the vectors' id; other columns are payload."""

    def __init__(self, store: Snapshots, key: str = "vec_id", vector: str = "embedding"):
        self.store, self.key, self.vector = store, key, vector

    def size(self) -> int | None:
        """The length of the vectors, None without a collection."""
        version = self.store.active()
        return self.store.manifest(version)["config"]["dims"] if version else None

    def ensure(self, rows: DataFrame, dims: int, recreate: bool = False) -> bool:
        """Builds the collection where there is none, or one of other vector lengths; says whether it did."""
        if not recreate and self.size() == dims:
            return False
        self.build(rows, dims)
        return True

    def build(self, rows: DataFrame, dims: int, cells: int | None = None) -> str:
        """A new version of all rows with a vector, normalised; the pointer moves at its end. Raises for vectors of another length."""
        unit = rows.filter(F.col(self.vector).isNotNull()).withColumn("v", normalized(finite(F.col(self.vector)))).drop(self.vector)
        kept = stored(unit, "vectors")
        size = kept.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
        if size["n"] and (size["low"], size["high"]) != (dims, dims):
            raise ValueError(f"vectors of {size['low']} to {size['high']} numbers in a collection of {dims}")
        k = min(cells or max(1, round(size["n"] ** 0.5)), MOST_CELLS, max(1, size["n"]))
        centroids = _centroids(kept.select(F.col(self.key).alias("vec_id"), "v"), k, ROUNDS) if size["n"] else np.zeros((1, dims))
        at = kept.columns.index("v")

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell, far = _nearest(_matrix(b.column(at), dims), centroids)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(far), pa.array(cell.astype("int32"))], names=[*b.schema.names, "far", "cell"])

        schema = StructType([*kept.schema.fields, StructField("far", DoubleType()), StructField("cell", IntegerType())])
        placed = stored(kept.mapInArrow(place, schema), "placed")
        middle = self.store.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
        borders = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("near"), F.max("far").alias("radius"))
        version = f"v{(int(self.store.active()[1:13]) if self.store.active() else 0) + 1:012d}-{uuid.uuid4().hex[:8]}"
        tables = {"vectors": placed.hint("rebalance", F.col("cell")), "cells": middle.join(borders, "cell")}
        self.store.build(version, tables, {"dims": dims, "cells": k}, by={"vectors": "cell"})
        self.store.switch(version)
        for t in (kept, placed):
            self.store._fs.delete(self.store._path(t._scratch), True)
        return version

    def scroll(self, after=None, limit: int = 256, vectors: bool = False) -> DataFrame:
        """The next rows by id after one, without reading vectors unless asked to. The last id is where to go on."""
        rows = self.store.table("vectors").drop("far", "cell")
        rows = rows if vectors else rows.drop("v")
        rows = rows if after is None else rows.filter(F.col(self.key) > after)
        return rows.orderBy(self.key).limit(limit)

    def search(self, questions: DataFrame, k: int, where: Column | None = None) -> DataFrame:
        """(query_id, key, score, rank): the k best of each question (query_id, v: unit vector) among rows that satisfy `where`, ties by key.

        Questions go out in chunks of SENT bytes, of which there is one at a time on the driver. `_cells` of the result: cells read, and all.
        """
        version = self.store.active()
        dims = self.store.manifest(version)["config"]["dims"]
        cells = self.store.table("cells", version).orderBy("cell").toArrow()  # MOST_CELLS rows at most
        centroids = _matrix(cells.column("centroid").combine_chunks(), dims) if len(cells) else np.zeros((0, dims))
        numbers, n, near, radius = (cells.column(c).to_numpy() for c in ("cell", "n", "near", "radius"))
        rows = self.store.table("vectors", version)
        rows = rows if where is None else rows.filter(where)
        asked = questions.select("query_id", F.col("v").cast("array<double>").alias("v"))
        chunks = max(1, -(-(asked.count() * dims * 8) // SENT))
        out, read = None, set()
        for c in range(chunks):
            some = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(chunks)) == c).toArrow().drop_null().combine_chunks()
            ids = some.column("query_id").combine_chunks() if len(some) else pa.array([], "int64")
            if len(some) and (lengths := set(np.diff(some.column("v").combine_chunks().offsets.to_numpy()).tolist())) != {dims}:
                raise ValueError(f"questions of {sorted(lengths)} numbers in a collection of {dims}")
            matrix = _matrix(some.column("v").combine_chunks(), dims) if len(some) else np.zeros((0, dims))
            far = np.sqrt(np.maximum(0, (matrix**2).sum(1)[:, None] + (centroids**2).sum(1) - 2 * matrix @ centroids.T))
            order = np.argsort(far, axis=1)
            before = np.cumsum(n[order], axis=1) - n[order] if len(n) else far
            first = np.zeros(far.shape, bool)
            np.put_along_axis(first, order, before < k, axis=1)  # the nearest cells, until they hold k rows
            one = stored(self._scored(rows, first, numbers, ids, matrix, far, np.full(len(ids), -np.inf), k), "found")
            best = top(one, "query_id", "score", self.key, k).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).filter(F.col("n") >= k)
            least = {r["query_id"]: r["least"] for r in best.collect()}  # a row for each question of the chunk
            floor = np.array([least.get(q, -np.inf) for q in ids.to_pylist()])
            reach = np.where(np.isfinite(floor), np.sqrt(np.maximum(0, (matrix**2).sum(1) + 1 - 2 * (floor - SLACK))), np.inf)[:, None] + SLACK
            rest = ~first & (far - radius <= reach) & (near - far <= reach)
            read |= set(numbers[(first | rest).any(0)].tolist())
            two = self._scored(rows, rest, numbers, ids, matrix, far, floor, k)
            both = one.unionByName(two)
            out = both if out is None else out.unionByName(both)
        found = top(out, "query_id", "score", self.key, k)
        found._cells = len(read), len(numbers)
        return found

    def _scored(self, rows: DataFrame, probed: np.ndarray, numbers: np.ndarray, ids: pa.Array, matrix: np.ndarray, far: np.ndarray, floor: np.ndarray, k: int) -> DataFrame:
        """(query_id, key, score) of rows of probed cells (question x cell) that reach the floor, no more than the k best of a batch and its ties."""
        used = np.flatnonzero(probed.any(0))
        by_cell = {int(numbers[c]): (np.flatnonzero(probed[:, c]), far[probed[:, c], c]) for c in used}
        reach = np.where(np.isfinite(floor), np.sqrt(np.maximum(0, (matrix**2).sum(1) + 1 - 2 * (floor - SLACK))), np.inf) + SLACK
        key = self.key
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                cells = whole.column("cell").to_numpy()
                for cell in np.unique(cells).tolist():
                    own = whole.filter(pa.array(cells == cell))
                    asked_by, distance = by_cell[cell]
                    ring = own.column("far").to_numpy()
                    for a in range(0, own.num_rows, 4096):
                        m, r = _matrix(own.slice(a, 4096).column("v"), matrix.shape[1]), ring[a : a + 4096]
                        for f in range(0, len(asked_by), 256):
                            some = asked_by[f : f + 256]
                            keep = np.abs(distance[f : f + 256][:, None] - r) <= reach[some][:, None]
                            near = np.flatnonzero(keep.any(0))
                            scores = np.round(matrix[some] @ m[near].T, DIGITS) + 0.0
                            good = keep[:, near] & (scores >= floor[some][:, None])
                            if len(near) > k:
                                good &= scores >= -np.partition(-np.where(good, scores, -np.inf), k - 1, axis=1)[:, k - 1 : k]
                            i, j = np.nonzero(good)
                            yield pa.RecordBatch.from_arrays([ids.take(pa.array(some[i])), own.column(key).take(pa.array(a + near[j])), pa.array(scores[i, j])], names=["query_id", key, "score"])

        kind = "bigint" if pa.types.is_int64(ids.type) else {pa.string(): "string", pa.int32(): "int"}[ids.type]
        return rows.filter(F.col("cell").isin([int(numbers[c]) for c in used])).select(key, "v", "far", "cell").mapInArrow(run, f"query_id {kind}, {key} {kinds[key]}, score double")

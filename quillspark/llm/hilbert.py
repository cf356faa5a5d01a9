"""Sharding along a Hilbert curve over several metadata columns.

Each column is quantised by its own quantiles (order-preserving), the codes give a position on the curve, rows are put
in curve order, and the order is cut into runs of equal row counts. Rows near each other in all columns then share
files, so that minimum and maximum of any of the columns prune shards.

Numbers are quantised by one sketch of all rows, strings by exact quantiles of all rows in the order of their bytes. Nulls take
the lowest code; equal rows are adjacent; an empty table gives no rows; other columns of the input play no part in the order.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop, fresh, offsets, ordered, partitions, table

BITS = 6


def curve_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of axes (rows x dimensions, 0 <= code < 2**bits), after Skilling (2004)."""
    x = axes.astype(np.uint64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = np.uint64(q - 1)
        for i in range(d):
            high = (x[i] & np.uint64(q)) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & np.uint64(q)) != 0, t ^ np.uint64(q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return out.astype(np.int64)


def _string_cuts(df: DataFrame, c: str, steps: int) -> list[str]:
    """Up to steps - 1 values that cut the rows, by this column without nulls, into runs of equal counts."""
    counted = df.select(F.col(f"`{c}`").alias("value")).filter("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    rows = ordered(counted, [F.col("value")], partitions(df.sparkSession))
    before, total = offsets(rows, F.sum("n"))
    inside = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("_before") + F.sum("n").over(inside)
    at = rows.join(F.broadcast(before), "_part").select("value", upto.alias("upto"), F.col("n"))  # a row for each partition
    step = lambda x: F.floor(x * steps / max(total, 1))
    found = [r["value"] for r in at.filter(step(F.col("upto")) > step(F.col("upto") - F.col("n"))).orderBy("value").limit(steps).collect()]
    drop(rows)
    return found[: steps - 1]


def with_curve_index(df: DataFrame, dims: list[str], extra: list[Column], bits: int = BITS) -> DataFrame:
    """extra columns and `curve_index`."""
    kinds, quantiles = dict(df.dtypes), [i / 2**bits for i in range(1, 2**bits)]
    columns = [F.col(f"`{c}`") if kinds[c] == "string" else F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("-inf"))) for c in dims]
    numbers = [i for i, c in enumerate(dims) if kinds[c] != "string"]
    found = df.agg(F.lit(0), *[F.percentile_approx(columns[i], quantiles, 10000).alias(f"q{i}") for i in numbers]).first()
    cuts: list = [np.array(found[f"q{i}"] or [], dtype="float64") if i in numbers else [x.encode("utf-8", "surrogatepass") for x in _string_cuts(df, c, 2**bits)] for i, c in enumerate(dims)]

    def code(cut: np.ndarray | list[bytes], values: pd.Series) -> np.ndarray:
        if isinstance(cut, np.ndarray):
            return np.searchsorted(cut, values.to_numpy("float64"), side="left")
        names, which = np.unique(values.fillna("").to_numpy(dtype=object), return_inverse=True)
        codes = np.array([bisect_left(cut, x.encode("utf-8", "surrogatepass")) for x in names], "int64")
        return np.where(values.isna(), 0, codes[which])

    @F.pandas_udf("long")
    def index(*values: pd.Series) -> pd.Series:
        return pd.Series(curve_index(np.stack([code(c, v) for c, v in zip(cuts, values, strict=True)], axis=1), bits))

    return df.select(*extra, index(*columns).alias("curve_index"))


def hilbert_shards(df: DataFrame, dims: list[str], shards: int, keep: list[Column], tie: list[str]) -> DataFrame:
    """keep columns, `curve_index`, `shard` (row counts at most one apart) and `slot` (gapless from 0 in each shard)."""
    spark = df.sparkSession
    base = cut(with_curve_index(df, dims, keep))
    rows = ordered(base, [F.col(c) for c in ["curve_index", *tie]], partitions(spark))
    drop(base)
    before, n = offsets(rows, F.count("*"))
    rank = F.col("_before") + F.col("_pos")
    placed = rows.join(F.broadcast(before), "_part").withColumn("_rank", rank)  # a row for each partition
    shard = F.expr(f"_rank * {shards} div {max(n, 1)}")
    first = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("_rank") - first).withColumn("shard", F.col("shard").cast("int")).drop("_part", "_pos", "_before", "_rank")


def write_shards(df: DataFrame, dims: list[str], shards: int, path: str) -> None:
    """All rows of df, each once, in folders by shard, and in these in files by slot; names that df has are not taken again.

    A null or repeated key makes no difference, as rows are carried along, not joined. A shard is as many files as it takes tasks.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    placed = hilbert_shards(df, dims, shards, [row, F.monotonically_increasing_id().alias("tie")], ["tie"])
    shard, slot = fresh(df, "shard"), fresh(df, "slot")
    out = placed.select("row.*", F.col("shard").alias(shard), F.col("slot").alias(slot))
    out.repartitionByRange(F.col(shard), F.col(slot)).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def zone_map(placed: DataFrame, dims: list[str]) -> DataFrame:
    """Per shard the least and greatest value of each dimension, which readers prune by."""
    return placed.groupBy("shard").agg(F.count("*").alias("n_rows"), *[f(c).alias(f"{n}_{c}") for c in dims for n, f in (("min", F.min), ("max", F.max))])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    keep = [F.col("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"), F.col("source"), F.col("lang"), F.col("n_chars")]
    placed = hilbert_shards(docs, ["source", "lang", "n_chars"], 40, keep, ["size", "text_crc32", "doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve_index", "source", "lang", "n_chars")

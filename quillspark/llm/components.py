"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

#: Most rows of two numbers that are broadcast; beyond them a join shuffles, and Spark splits the rows of a large star.
SMALL = 200_000


def _sized(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A scratch table, and itself or a hint to broadcast it where its counted size allows."""
    kept = cut(rows)
    return kept, F.broadcast(kept) if kept.count() <= SMALL else kept


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b); root is the least node that is reachable. Alternating large and small stars.

    Each round is a few joins on node and a scratch table; rounds grow with the logarithm of the longest chain. Ends of no link
    (a null, or a = b) are left out; an empty table gives no rows.
    """
    now, before = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()), None
    digest = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        one, least = _sized(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct())
        two, low = _sized(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        then = cut(small)
        last, before = before, tuple(then.agg(*digest).first())
        same = last == before and now.exceptAll(then).isEmpty()
        drop(now, one, large, two)
        now = then
        if same:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._scratch = now._scratch
            return out

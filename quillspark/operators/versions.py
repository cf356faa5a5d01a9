"""Manifests of document versions: differences, plans, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def difference(before: DataFrame, now: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """(key, status): added, deleted, modified or unchanged by null-safe equality of the compared columns."""
    b = before.select(key, F.lit(True).alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in compared])
    n = now.select(key, F.lit(True).alias("_n"), *compared)
    same = F.lit(True)
    for c in compared:
        same = same & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    status = F.when(F.col("_b").isNull(), "added").when(F.col("_n").isNull(), "deleted").when(same, "unchanged").otherwise("modified")
    return n.join(b, key, "full_outer").select(key, status.alias("status"))


def sync_plan(local: DataFrame, remote: DataFrame, key: str, digest: str, delete: bool) -> DataFrame:
    """(key, action): upload, skip, delete or keep."""
    l, r = local.select(key, F.col(digest).alias("_l")), remote.select(key, F.col(digest).alias("_r"))  # noqa: E741
    action = F.when(F.col("_r").isNull(), "upload").when(F.col("_l").isNull(), "delete" if delete else "keep").when(F.col("_l") == F.col("_r"), "skip").otherwise("upload")
    return l.join(r, key, "full_outer").select(key, action.alias("action"))


def retained(versions: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """versions with `kept`: the newest n of each key; the newest that is no deletion takes the last place if it is not among them."""
    w = Window.partitionBy(key).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = versions.withColumn("_r", F.row_number().over(w)).withColumn("_u", F.min(F.when(~F.col("deleted"), F.col("_r"))).over(whole))
    late = F.coalesce(F.col("_u") > n, F.lit(False))
    kept = F.when(late, (F.col("_r") < n) | (F.col("_r") == F.col("_u"))).otherwise(F.col("_r") <= n)
    return rows.withColumn("kept", kept).drop("_r", "_u")


def newest_tables(names: DataFrame, active: str, n: int) -> DataFrame:
    """names with `kept`: the active one and the newest others, n in all. The newest come from a top-n, so nothing is sorted as a whole."""
    newest = names.filter(F.col("name") != active).select("name").distinct().orderBy(F.desc("name")).limit(max(1, n) - 1).withColumn("_new", F.lit(True))
    rows = names.join(F.broadcast(newest), "name", "left")  # n - 1 rows
    return rows.withColumn("kept", (F.col("name") == active) | F.coalesce("_new", F.lit(False))).drop("_new")


def fingerprint(rows: DataFrame, parts: list[str]) -> DataFrame:
    """One row: a digest of the sorted rows, independent of their order and partitioning."""
    one = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in parts]), 256)
    # Digests of equal prefixes are digested first, so that no list grows with the table's size beyond its share.
    part = rows.select(one.alias("d")).groupBy(F.substring("d", 1, 3).alias("p")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("d")), "|"), 256).alias("d"))
    return part.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "d"))), lambda x: x["d"]), "|"), 256).alias("fingerprint"))

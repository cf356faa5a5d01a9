"""Metrics of routing, retrieval and load."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _share(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)


def confusion(cases: DataFrame, by: list[str]) -> DataFrame:
    """Counts and rates of a yes-no decision. cases: expected, predicted (booleans)."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    e, p = F.col("expected"), F.col("predicted")
    tp, fp, fn, tn = n(e & p), n(~e & p), n(e & ~p), n(~e & ~p)
    out = [F.count("*").alias("total"), _share(tp + tn, F.count("*")).alias("accuracy"), _share(tp, tp + fp).alias("rag_precision"), _share(tp, tp + fn).alias("rag_recall"), _share(tn, tn + fp).alias("direct_recall"), fp.alias("false_rag"), fn.alias("false_direct")]
    return cases.groupBy(*by).agg(*out) if by else cases.agg(*out)


def route_prefixes(routes: DataFrame, by: list[str]) -> DataFrame:
    """(by, prefix, n): how many decisions each step has made, by the part of the route before the last underscore."""
    return routes.groupBy(*by, F.regexp_replace("route", "_[^_]*$", "").alias("prefix")).agg(F.count("*").alias("n"))


def variants(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row of differences between two variants of one case set. Both: id, expected, predicted."""
    j = a.select("id", "expected", F.col("predicted").alias("pa")).join(b.select("id", F.col("predicted").alias("pb")), "id")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    e, x, y = F.col("expected"), F.col("pa"), F.col("pb")
    return j.agg(F.count("*").alias("shared"), n(x != y).alias("changed"), n((x != e) & (y == e)).alias("fixed"), n((x == e) & (y != e)).alias("regressions"), n(x & ~y & ~e).alias("direct_savings"), n(x & ~y & e).alias("rag_misses"))


def retrieval(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """One row: recall@k, precision@k and MRR, means over questions with gold. ranked: query_id, doc_id, rank; gold: query_id, doc_id."""
    hits = ranked.join(gold, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias("h"), F.min("rank").alias("first"))
    per = gold.groupBy("query_id").agg(F.count("*").alias("g")).join(hits, "query_id", "left")
    h = F.coalesce("h", F.lit(0))
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return per.agg(F.count("*").alias("n_queries"), mean(h / F.col("g")).alias("recall_at_k"), mean(h / F.lit(k)).alias("precision_at_k"), mean(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))


def at_places(rows: DataFrame, by: str, value: str, places: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """by, `n` and the exact values at the places (from 0, by their number of rows n) of each key's values in order.

    Values are counted before they are shuffled, and an approximate histogram of each key parts them into 1024 bins or fewer; only bins that
    hold a wanted place are sorted, each on its own, so that a hot key is not one task. Null values take no part, a null key is a key.
    """
    rows = rows.filter(F.col(value).isNotNull()).select(F.col(by).alias("_by"), F.col(value).alias("_v"))
    counted = rows.groupBy("_by", "_v").agg(F.count("*").alias("_k"))
    cuts = rows.groupBy("_by").agg(F.percentile_approx(F.col("_v").cast("double"), [i / 1024 for i in range(1, 1024)], 10_000).alias("_cuts"))
    half = F.array(*(F.lit(1 << i) for i in range(9, -1, -1)))  # binary search for the cuts below a value
    place = F.aggregate(half, F.lit(0), lambda i, s: i + F.when(F.get("_cuts", i + s - 1) < F.col("_v").cast("double"), s).otherwise(0))
    binned = _joined(counted, cuts, "_by").withColumn("_bin", place).drop("_cuts")
    in_bin, of_key = Window.partitionBy("_by").orderBy("_bin"), Window.partitionBy("_by")  # 1024 rows a key
    bins = binned.groupBy("_by", "_bin").agg(F.sum("_k").alias("_m")).withColumns({"_end": F.sum("_m").over(in_bin), "n": F.sum("_m").over(of_key)})
    wanted = places(F.col("n"))
    asked = F.array(*(F.struct(F.lit(name).alias("name"), at.cast("long").alias("at")) for name, at in wanted.items()))
    mine = F.filter(asked, lambda x: (x["at"] >= F.col("_end") - F.col("_m")) & (x["at"] < F.col("_end")))
    chosen = bins.select("_by", "_bin", "n", (F.col("_end") - F.col("_m")).alias("_before"), mine.alias("_asked")).filter(F.size("_asked") > 0)
    run = Window.partitionBy("_by", "_bin").orderBy("_v")
    found = _joined(binned, chosen, "_by", "_bin").withColumn("_to", F.col("_before") + F.sum("_k").over(run))
    hits = found.select("_by", "n", "_v", "_k", "_to", F.explode("_asked").alias("a")).filter((F.col("a.at") < F.col("_to")) & (F.col("a.at") >= F.col("_to") - F.col("_k")))
    return hits.groupBy(F.col("_by").alias(by), "n").agg(*(F.max(F.when(F.col("a.name") == name, F.col("_v"))).alias(name) for name in wanted))


def _joined(a: DataFrame, b: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """An equi-join where null keys meet."""
    b = b.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return a.join(b, on, how).drop(*(f"_of_{k}" for k in keys))


def _between(p: float, n: Column) -> tuple[Column, Column]:
    """The places around the point p of n values."""
    at = (n - 1) * F.lit(p)
    return F.floor(at), F.ceil(at)


def _point(p: float, low: str, high: str) -> Column:
    at = (F.col("n") - 1) * F.lit(p)
    return F.col(low) + (F.col(high) - F.col(low)) * (at - F.floor(at))


def latencies(rows: DataFrame, by: str, value: str) -> DataFrame:
    """count, avg, min, max and the exact 50, 95 and 99 % points with linear interpolation."""
    points = {50: 0.5, 95: 0.95, 99: 0.99}
    exact = at_places(rows, by, value, lambda n: {f"_{side}{k}": at for k, p in points.items() for side, at in zip("lh", _between(p, n), strict=True)})
    exact = exact.select(by, *(F.round(_point(p, f"_l{k}", f"_h{k}"), 6).alias(f"p{k}") for k, p in points.items()))
    r = rows.groupBy(by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"))
    return _joined(r, exact, by, how="left")


def slope(rows: DataFrame, by: str, y: str, x: str) -> DataFrame:
    """Least-squares slope; 0 for fewer than two points or no spread."""
    return rows.groupBy(by).agg(F.round(F.coalesce(F.regr_slope(y, x), F.lit(0.0)), 6).alias("slope"))


def top_values(rows: DataFrame, column: str, k: int) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def index_percentile(rows: DataFrame, by: str, value: str, p: float) -> DataFrame:
    """The value at int(n * p), and the median."""
    exact = at_places(rows, by, value, lambda n: {"p": F.least(F.floor(n * F.lit(p)), n - 1), **dict(zip(("_l", "_h"), _between(0.5, n), strict=True))})
    return exact.select(by, "p", F.round(_point(0.5, "_l", "_h"), 6).alias("median"))

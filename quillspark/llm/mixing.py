"""Mixing sources to target weights by entropy balancing.

Documents get rates as close as possible to one (in relative entropy, summed over documents) under the constraint that
each source's words come to its target, with no rate above `cap`. The dual has one multiplier a source; the rate of a
document is min(cap, exp(multiplier * size / mean size of its source)). Newton's steps, kept inside a bracket, solve it;
each step is one aggregation over (source, size, count), which is exact since documents of one source and size share
their rate. Rates become whole copies by systematic rounding along the order by source and falling size, and what then
is left of a target goes to single documents picked from geometric size classes.

Null texts and texts without words have size 0 and rate one, but take nothing. Null sources form one source, last in order. Equal
rows are separate documents. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop, fresh, offsets, ordered, partitions, table, word_count

WEIGHTS = (5, 2, 1)
CAP = 3.0


def targets(sizes: list[tuple[str | None, int]], weights: tuple = WEIGHTS, cap: float = CAP) -> dict[str | None, float]:
    """Each source's target in words: the total by weight, no more than cap times its size, the excess shared again."""
    names = sorted((s for s, _ in sizes if s is not None)) + [s for s, _ in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    size, left, out = dict(sizes), float(sum(n for _, n in sizes)), {}
    open_ = list(names)
    while open_:
        each = left / sum(weight[x] for x in open_)
        share = {s: each * weight[s] for s in open_}
        full = [s for s in open_ if share[s] > cap * size[s]]
        if not full:
            return out | share
        for s in full:
            out[s] = cap * size[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in full]
    return out


class Dual:
    """One source's multiplier, found by Newton's steps inside a bracket."""

    def __init__(self, target: float, size: float, docs: int, cap: float):
        self.target, self.mean, self.cap = target, max(size / max(docs, 1), 1e-9), cap
        self.at, self.low, self.high = 0.0, -math.inf, math.inf
        self.done = size == 0 or target <= 0 or target >= cap * size * (1 - 1e-12)
        self.fixed = None if not self.done else 1.0 if size == 0 else 0.0 if target <= 0 else cap

    def step(self, value: float, slope: float) -> None:
        if abs(value - self.target) <= 1e-9 * self.target:
            self.done = True
            return
        self.low, self.high = (self.at, self.high) if value < self.target else (self.low, self.at)
        to = self.at + (self.target - value) / slope if slope > 0 else math.inf
        if not self.low < to < self.high or abs(to - self.at) > 50:
            to = (self.low + self.high) / 2 if math.isfinite(self.low + self.high) else self.at + math.copysign(1 + abs(self.at), self.target - value)
        self.done, self.at = self.high - self.low < 1e-13, to


def solve(hist: DataFrame, duals: dict[str | None, Dual], cap: float, most: int = 400) -> DataFrame:
    """(source, lam, mean, fixed) after Newton's iterations over the distributed histogram (source, size, n).

    Where Newton's step leaves the bracket the bracket is halved, so that some 60 steps settle a source; one that has not
    settled after `most` steps raises.
    """
    spark = hist.sparkSession

    def state() -> DataFrame:
        return spark.createDataFrame([(s, d.at, d.mean, d.fixed) for s, d in duals.items()], "source string, lam double, mean double, fixed double")

    for _ in range(most):
        if all(d.done for d in duals.values()):
            break
        u = F.col("size") / F.col("mean")
        power = F.least(F.col("lam") * u, F.lit(math.log(cap)))
        words = F.col("n") * F.col("size") * F.exp(power)
        h = hist.alias("h").join(state().filter("fixed is null").alias("s"), F.col("h.source").eqNullSafe(F.col("s.source"))).select("h.*", "lam", "mean")
        found = h.groupBy("source").agg(F.sum(words).alias("value"), F.sum(F.when(F.col("lam") * u < math.log(cap), words * u).otherwise(0.0)).alias("slope")).collect()
        for r in found:
            if not duals[r["source"]].done:
                duals[r["source"]].step(r["value"], r["slope"])
    if open_ := [s for s, d in duals.items() if not d.done]:
        raise ArithmeticError(f"no solution after {most} steps for {len(open_)} sources, such as {open_[0]!r}")
    return state()


def copies(docs: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, source, size, source_size, target, rate and whole `copies` of each document."""
    spark = docs.sparkSession
    base = cut(docs.select(*keep, "source", word_count(F.col("text")).alias("size")))
    hist = cut(base.groupBy("source", "size").agg(F.count("*").alias("n")))
    totals = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("docs")).collect()  # a row for each source
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = targets([(r["source"], r["words"]) for r in totals], weights, cap)
    duals = {r["source"]: Dual(goal[r["source"]], r["words"], r["docs"], cap) for r in totals}
    solve(hist, duals, cap)
    rows, start = [], 0
    for r in totals:
        d = duals[r["source"]]
        rows.append((r["source"], r["words"], float(goal[r["source"]]), d.at, d.mean, d.fixed, start))
        start += r["docs"]
    per = spark.createDataFrame(rows, "source string, source_size long, target double, lam double, mean double, fixed double, _start long")
    rate = F.coalesce(F.col("fixed"), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(math.log(cap)))))
    cells = hist.alias("h").join(per.alias("s"), F.col("h.source").eqNullSafe(F.col("s.source"))).select("h.*", "source_size", "target", "_start", rate.alias("rate"))
    earlier = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each size, not for each document
    cells = cells.withColumn("_first", F.col("_start") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("_rates", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(earlier), F.lit(0.0)))
    placed = ordered(base, [F.col("source").asc_nulls_last(), F.col("size").desc(), *[F.col(c).asc_nulls_last() for c in keep]], partitions(spark))
    drop(base)
    before, _ = offsets(placed, F.count("*"))
    ranked = placed.join(F.broadcast(before), "_part").withColumn("_rank", F.col("_before") + F.col("_pos")).drop("_before")  # a row for each partition
    same = F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.size") == F.col("c.size"))
    joined = ranked.alias("d").join(cells.alias("c"), same).select("d.*", "source_size", "target", "rate", "_first", "_rates")
    k = F.col("_rates") + (F.col("_rank") - F.col("_first")) * F.col("rate") + 0.5
    rounded = joined.withColumn("copies", (F.floor(k + F.col("rate")) - F.floor(k)).cast("long")).drop("_rank", "_first", "_rates")
    return _settle(cut(rounded), cap).drop("_part", "_pos")


def _moves(left: float, places: list[tuple], cap: int) -> dict[tuple, int]:
    """Copies more or less of single documents (part, place, size, copies) that bring left near 0: the best one or two changes, again and again."""
    open_ = [(x[2], x[:2], 1) for x in places if x[3] < cap] + [(-x[2], x[:2], -1) for x in places if x[3] > 0]
    out: dict[tuple, int] = {}
    for _ in range(16):
        open_ = sorted(o for o in open_ if o[1] not in out)
        if abs(left) < 0.5 or not open_:
            break
        size = np.array([0.0, *[o[0] for o in open_]])  # 0: no second change
        order = np.argsort(size, kind="stable")
        at = np.searchsorted(size[order], left - size[1:])
        best = (abs(left), None)
        for shift in (-1, 0):
            second = order[np.clip(at + shift, 0, len(size) - 1)]
            off = np.abs(left - size[1:] - size[second])
            i = int(off.argmin())
            if off[i] < best[0] - 1e-9 and (second[i] == 0 or open_[second[i] - 1][1] != open_[i][1]):
                best = (off[i], (i, second[i]))
        if best[1] is None:
            break
        for k in (best[1][0], best[1][1] - 1):
            if k >= 0:
                out[open_[k][1]] = open_[k][2]
                left -= open_[k][0]
    return out


def _settle(rows: DataFrame, cap: float) -> DataFrame:
    """Moves each source's words closer to its target by one copy more or less of single documents, two of each step of sizes."""
    spark = rows.sparkSession
    step = F.floor(F.log2(F.col("size").cast("double")) * 4).cast("int")
    one = F.struct("_part", "_pos", "size", "copies")
    words = F.sum(F.col("copies") * F.col("size"))
    some = rows.filter((F.col("size") > 0) & (F.col("target") > 0))
    found = some.groupBy("source", step.alias("step")).agg(F.min(one).alias("a"), F.max(one).alias("z"), words.alias("words"), F.max("target").alias("target")).collect()  # some seventy steps a source
    by: dict[str | None, list] = {}
    for r in found:
        by.setdefault(r["source"], []).append(r)
    moves: dict[tuple, int] = {}
    for source in sorted(by, key=lambda s: (s is None, s or "")):
        group = by[source]
        places = sorted({tuple(r[k]) for r in group for k in ("a", "z")})
        moves |= _moves(group[0]["target"] - sum(r["words"] for r in group), places, int(cap))
    fixes = spark.createDataFrame([(p, q, m) for (p, q), m in moves.items()], "_part int, _pos long, _move long")
    return rows.join(fixes, ["_part", "_pos"], "left").withColumn("copies", F.col("copies") + F.coalesce(F.col("_move"), F.lit(0))).drop("_move")


def mixture(docs: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """The documents as the mix takes them: each row as often as its copies say. Names and kinds of other columns do not matter."""
    every = [F.col(f"`{c}`") for c in docs.columns]
    hashable = [F.to_json(F.struct(x)) if "map<" in kind else x for x, (_, kind) in zip(every, docs.dtypes, strict=True)]
    one, two, n, k = (fresh(docs, c) for c in ("key1", "key2", "copies", "copy"))
    keyed = docs.withColumns({one: F.xxhash64(*hashable), two: F.hash(*hashable)})
    plan = copies(keyed.select(F.col(one).alias("key1"), F.col(two).alias("key2"), "source", "text"), weights, cap, ("key1", "key2"))
    plan = plan.groupBy("key1", "key2").agg(F.sum("copies").alias(n)).filter(F.col(n) > 0).select(F.col("key1").alias(one), F.col("key2").alias(two), n)
    # Equal rows are interchangeable: one of them stands for the copies of all.
    rows = keyed.join(plan, [one, two]).dropDuplicates([one, two])
    return rows.withColumn(k, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*every)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = copies(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")

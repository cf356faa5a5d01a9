"""Call graphs: building, matching names, callers, chains, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tail_name(name: Column) -> Column:
    return F.element_at(F.split(F.element_at(F.split(name, r"\."), -1), "::"), -1)


def suffixes(name: Column) -> Column:
    """A qualified name, its ends after each separator, and its last part."""
    ends = lambda sep, pattern: F.transform(F.sequence(F.lit(1), F.size(F.split(name, pattern))), lambda i: F.array_join(F.slice(F.split(name, pattern), i, F.size(F.split(name, pattern))), sep))
    return F.array_sort(F.array_distinct(F.concat(F.array(name), ends("::", "::"), ends(".", r"\."), F.array(tail_name(name)))))


#: Wanted names up to which they are broadcast.
FEW = 200_000


def matching(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, id): exact ids alone where there are any, else nodes whose label ends in the name. An equi-join over name ends; few names go to the nodes, as a name that many nodes bear would be one task's."""
    few = wanted.count() <= FEW
    sent = lambda names: F.broadcast(names) if few else names
    exact = nodes.select(F.col("id").alias("wanted"), "id").join(sent(wanted), "wanted")
    ends = nodes.select("id", F.explode(F.array_distinct(F.concat(suffixes(F.col("label")), F.array(F.col("name"))))).alias("wanted"))
    others = ends.join(sent(wanted.join(exact.select("wanted"), "wanted", "left_anti")), "wanted").select("wanted", "id").distinct()
    return exact.select("wanted", "id").unionByName(others)


def callers(edges: DataFrame, targets: DataFrame) -> DataFrame:
    return edges.join(targets.select(F.col("id").alias("callee")), "callee", "left_semi").select(F.col("caller").alias("id")).distinct()


def chain(edges: DataFrame, roots: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(nodes with their depth, edges) reachable within depth calls; a node's depth is that of its shortest way, so cycles add nothing.

    Each step reads the nodes of the step before it alone, so that the plan does not double from step to step; a step has at most all nodes.
    """
    edges = edges.select("caller", "callee").distinct()
    step = roots.select("id").distinct()
    reached = step.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        step = edges.join(step, F.col("caller") == F.col("id"), "left_semi").select(F.col("callee").alias("id")).distinct()
        reached = reached.unionByName(step.withColumn("depth", F.lit(d)))
    seen = reached.groupBy("id").agg(F.min("depth").alias("depth"))
    walked = edges.join(seen.filter(F.col("depth") < depth).select(F.col("id").alias("caller")), "caller", "left_semi")
    return seen, walked


def pairs(edges: DataFrame) -> DataFrame:
    """(low, high, ways): nodes that an edge joins, once for each two of them; ways: 1 if low calls high, 2 if high calls low, 3 for both. What has ways stays as it is."""
    if "ways" in edges.columns:
        return edges
    up = F.col("caller").isNull() | (F.col("caller") <= F.col("callee"))
    ends = F.when(up, F.col("caller")).otherwise(F.col("callee")), F.when(up, F.col("callee")).otherwise(F.col("caller"))
    way = F.when(up, 1).otherwise(2).cast("tinyint")
    return edges.select(ends[0].alias("low"), ends[1].alias("high"), way.alias("way")).groupBy("low", "high").agg(F.bit_or("way").alias("ways"))


def _either_way(p: DataFrame) -> DataFrame:
    """(id, neighbour), distinct as pairs are."""
    end = lambda a, b: F.struct(F.col(a).alias("id"), F.col(b).alias("neighbour"))
    both = F.when(F.col("low") == F.col("high"), F.array(end("low", "high"))).otherwise(F.array(end("low", "high"), end("high", "low")))
    return p.select(F.inline(both))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): distinct edges from and to each node. edges: (caller, callee), or their pairs."""
    p = pairs(edges).select(F.explode(F.array("low", "high")).alias("id"), F.bit_count("ways").alias("n"))
    return p.groupBy("id").agg(F.sum("n").alias("degree"))


def ranked_neighbours(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, limit: int = 4) -> DataFrame:
    """(id, neighbour, rank): neighbours either way, those in a seed's path first, then by falling degree and label. edges: (caller, callee), or their pairs."""
    both = _either_way(pairs(edges))
    paths = nodes.join(seeds.select("id"), "id", "left_semi").select("path").distinct().withColumn("same", F.lit(0))
    about = nodes.select(F.col("id").alias("neighbour"), "label", "path").join(paths, "path", "left").join(degrees(edges).withColumnRenamed("id", "neighbour"), "neighbour", "left")
    w = Window.partitionBy("id").orderBy(F.coalesce("same", F.lit(1)), F.desc("degree"), "label")
    return both.join(about.drop("path"), "neighbour").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("id", "neighbour", "rank")


def relevant(edges: DataFrame, nodes: DataFrame, seeds: list[str], most: int = 28, each: int = 4) -> tuple[list[str], DataFrame]:
    """Nodes around seeds, in order of a breadth-first walk with a budget of `most`, and the edges among them. The walk holds at most `most` nodes."""
    spark = edges.sparkSession
    chosen = list(dict.fromkeys(seeds))[:most]
    level = list(dict.fromkeys(seeds))
    for _ in range(2):
        if not level or len(chosen) >= most:
            break
        frame = spark.createDataFrame([(s,) for s in dict.fromkeys(seeds)], "id string")
        rows = ranked_neighbours(edges, nodes, frame, each).filter(F.col("id").isin(level)).collect()  # each * most rows
        by = {x: [r["neighbour"] for r in sorted((r for r in rows if r["id"] == x), key=lambda r: r["rank"])] for x in level}
        following = []
        for x in level:
            for y in by[x]:
                if len(chosen) < most and y not in chosen:
                    chosen.append(y)
                    following.append(y)
        level = following
    inside = F.col("caller").isin(chosen) & F.col("callee").isin(chosen)
    return chosen, edges.filter(inside)


def _best_neighbours(edges: DataFrame, nodes: DataFrame, each: int) -> tuple[DataFrame, DataFrame]:
    """(id, neighbour, degree, label, path): of each node the `each` neighbours first in rank, and the same of each path. No node gives more, however many neighbours it has."""
    both = _either_way(pairs(edges))
    about = nodes.select(F.col("id").alias("neighbour"), "label", "path").join(degrees(edges).withColumnRenamed("id", "neighbour"), "neighbour", "left")
    rows = both.join(about, "neighbour")
    order = [F.desc("degree"), F.col("label"), F.col("neighbour")]
    best = lambda *by: rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= each).drop("_r")
    return best("id"), best("id", "path")


def walks(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, most: int = 28, each: int = 4, levels: int = 2) -> DataFrame:
    """(set_id, place, id): around each set of seeds the nodes of a breadth-first walk with a budget of `most`, for all sets at once.

    seeds: set_id, place, id, from place 0 on; repeats count once, beyond the budget they are left out. From each node of a level its first
    neighbours either way follow in order (those in a seed's path first, then by falling degree, label and id), as far as the budget goes.
    nodes: id, label, path; edges: (caller, callee), or their pairs. A step takes at most most * each rows of a set.
    """
    first = seeds.groupBy("set_id", "id").agg(F.min("place").alias("place"))
    by_place = Window.partitionBy("set_id").orderBy("place")
    level = first.withColumn("place", F.row_number().over(by_place) - 1).filter(F.col("place") < most).select("set_id", "place", "id")
    paths = level.join(nodes.select("id", "path"), "id").select("set_id", "path").distinct().withColumn("same", F.lit(0))
    anywhere, in_path = _best_neighbours(edges, nodes, each)
    chosen = level
    for _ in range(levels):
        at = level.select("set_id", F.col("place").alias("from"), "id")
        near = at.join(in_path, "id").join(paths, ["set_id", "path"])
        far = at.join(anywhere, "id").join(paths, ["set_id", "path"], "left")
        both = near.select(*far.columns).unionAll(far).dropDuplicates(["set_id", "from", "neighbour"])
        of_node = Window.partitionBy("set_id", "from").orderBy(F.coalesce("same", F.lit(1)), F.desc("degree"), "label", "neighbour")
        ranked = both.withColumn("rank", F.row_number().over(of_node)).filter(F.col("rank") <= each)
        new = ranked.groupBy("set_id", F.col("neighbour").alias("id")).agg(F.min(F.struct("from", "rank")).alias("at")).join(chosen.select("set_id", "id"), ["set_id", "id"], "left_anti")
        have = chosen.groupBy("set_id").agg(F.count("*").alias("n"))
        placed = new.join(have, "set_id").withColumn("place", F.col("n") - 1 + F.row_number().over(Window.partitionBy("set_id").orderBy("at")))
        level = placed.filter(F.col("place") < most).select("set_id", F.col("place").cast("int").alias("place"), "id")
        chosen = chosen.unionByName(level)
    return chosen


def walked_edges(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """(set_id, caller, callee): distinct edges both of whose ends a set's walk has."""
    ids = chosen.select("id").distinct()
    e = edges.select("caller", "callee").distinct()
    e = e.join(ids.withColumnRenamed("id", "caller"), "caller", "left_semi").join(ids.withColumnRenamed("id", "callee"), "callee", "left_semi")
    one, two = (chosen.select("set_id", F.col("id").alias(c)) for c in ("caller", "callee"))
    return e.join(one, "caller").join(two, ["set_id", "callee"]).select("set_id", "caller", "callee")


def without_templates(name: Column) -> Column:
    """name without what stands between angle brackets, however deep these nest; a closing one without an opening one goes, too."""
    step = lambda a, c: F.struct(
        F.when(c == "<", a["depth"] + 1).when(c == ">", F.greatest(a["depth"] - 1, F.lit(0))).otherwise(a["depth"]).alias("depth"),
        F.when(c.isin("<", ">") | (a["depth"] > 0), a["out"]).otherwise(F.concat(a["out"], c)).alias("out"),
    )
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))
    return F.aggregate(F.split(name, ""), start, step, lambda a: a["out"])


def resolved(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """calls (repo, caller, callee, path) with `target`, the node that a callee's name means, if one alone does.

    In order: a qualified name; a name's end, its last part in the same file, its last part anywhere — each only if one node of
    the file or one node at all bears it. nodes: id, repo, qualified, path.
    """
    raw = F.trim(without_templates(F.replace("callee", F.lit("->"), F.lit("."))))
    scope = lambda sep: F.when(F.contains(F.col("caller"), F.lit(sep)), F.regexp_replace(F.col("caller"), f"{'[.]' if sep == '.' else sep}(?:(?!{'[.]' if sep == '.' else sep}).)*$", ""))
    own = F.when(raw.startswith("self."), F.concat(scope("."), F.lit("."), F.substring(raw, F.lit(6), F.length(raw))))
    this = F.when(raw.startswith("this."), F.concat(scope("::"), F.lit("::"), F.substring(raw, F.lit(6), F.length(raw))))
    names = F.array_distinct(F.filter(F.array(raw, own, this, tail_name(raw)), lambda x: x.isNotNull() & (x != "")))
    asks = calls.withColumn("_call", F.monotonically_increasing_id()).select("*", F.posexplode(names).alias("_p", "_name"))
    ends = nodes.select("repo", "id", F.col("path").alias("_path"), F.explode(suffixes(F.col("qualified"))).alias("_name"))
    tails = nodes.select("repo", "id", F.col("path").alias("_path"), tail_name(F.col("qualified")).alias("_tail"))

    def unique(rows: DataFrame, order: int) -> DataFrame:
        same = F.col("_path") == F.col("path")
        g = rows.groupBy("_call", "_p").agg(F.sum(F.when(same, 1).otherwise(0)).alias("s"), F.count("*").alias("n"), F.max(F.when(same, F.col("id"))).alias("here"), F.max("id").alias("any"))
        return g.select("_call", "_p", F.lit(order).alias("_o"), F.when(F.col("s") == 1, F.col("here")).when(F.col("n") == 1, F.col("any")).alias("target")).filter("target is not null")

    exact = asks.join(nodes.select("repo", F.col("qualified").alias("_name"), F.col("id").alias("target")), ["repo", "_name"]).groupBy("_call", "_p").agg(F.max("target").alias("target")).select("_call", "_p", F.lit(0).alias("_o"), "target")
    tailed = asks.withColumn("_tail", tail_name(F.col("_name"))).join(tails, ["repo", "_tail"])
    found = exact.unionByName(unique(asks.join(ends, ["repo", "_name"]), 1)).unionByName(unique(tailed.filter(F.col("_path") == F.col("path")), 2)).unionByName(unique(tailed, 3))
    best = found.groupBy("_call").agg(F.min_by("target", F.struct("_p", "_o")).alias("target"))
    return asks.filter("_p = 0").drop("_p", "_name").join(best, "_call").drop("_call")

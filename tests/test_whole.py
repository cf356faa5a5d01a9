"""Queries over the whole of their inputs, against brute force on small tables."""

import collections
import math

import pytest

from quillspark.operators import graph
from quillspark.plans import queries, registry
from quillspark.sources import scratch

#: Suppliers of each order's lines: far apart, backward, in a cycle, one that calls itself.
ORDERS = [[1, 50], [50, 90, 7], [7, 1], [5, 5], [90, 5], [60, 9], [1, 50], [33, 32]]


@pytest.fixture(scope="module")
def calls(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("calls"))
    lines = [(o, n, s, o * 10 + n, 1.0) for o, suppliers in enumerate(ORDERS) for n, s in enumerate(suppliers, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_extendedprice double").write.parquet(f"{d}/lineitem.parquet")
    known = sorted({s for o in ORDERS for s in o})
    spark.createDataFrame([(s, f"S{s:03}", s % 4) for s in known], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{d}/supplier.parquet")
    return d


def edges():
    return [(a, b, n) for o in ORDERS for n, (a, b) in enumerate(zip(o, o[1:], strict=False), 1)]


def test_call_chain_takes_all_edges(spark, calls):
    depth, now = {1: 0, 5: 0}, {1, 5}
    for d in range(1, 4):
        now = {b for a, b, _ in edges() if a in now} - set(depth)
        depth |= dict.fromkeys(now, d)
    assert depth == {1: 0, 5: 0, 50: 1, 90: 2, 7: 3}
    assert {r["id"]: r["depth"] for r in registry.QUERIES["call_chain"](spark, calls).collect()} == depth


def test_callers_take_all_edges(spark, calls):
    assert sorted(r["id"] for r in registry.QUERIES["callers"](spark, calls).collect()) == [5, 60, 90]


def test_edge_lines_take_all_edges(spark, calls):
    want = collections.defaultdict(set)
    for a, b, n in edges():
        want[a, b].add(n)
    got = {(r["caller"], r["callee"]): r["lines"] for r in registry.QUERIES["edge_lines"](spark, calls).collect()}
    assert got == {k: ",".join(map(str, sorted(v))) for k, v in want.items()}


def test_graph_elements_take_all_edges(spark, calls):
    got = registry.QUERIES["graph_elements"](spark, calls).collect()
    assert sorted((r["source"], r["target"]) for r in got if r["group"] == "edge") == sorted({(str(a), str(b)) for a, b, _ in edges()})
    assert sorted(int(r["id"]) for r in got if r["group"] == "node") == sorted({s for o in ORDERS for s in o})


def test_neighbours_take_all_edges(spark, calls):
    pairs = {(a, b) for a, b, _ in edges()}
    degree = collections.Counter(x for p in pairs for x in p)
    near = collections.defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    rank = lambda s: (s % 4 != 1, -degree[s], f"S{s:03}")
    want = {(x, y, k) for x, ys in near.items() for k, y in enumerate(sorted(ys, key=rank)[:4], 1)}
    assert {tuple(r) for r in registry.QUERIES["neighbours"](spark, calls).select("id", "neighbour", "rank").collect()} == want


def test_anchor_route_takes_whole_labels(spark, tmp_path):
    """The best anchors of both labels are their last rows."""
    turn = lambda i: [math.cos(i / 10), math.sin(i / 10)]
    given = [(i, turn(i), 0 if i < 12 else 1) for i in range(24)] + [(24 + i, turn(i), 2) for i in range(24)]
    spark.createDataFrame(given, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    score = lambda v, label: max(round(sum(x * y for x, y in zip(v, a, strict=True)), 6) for _, a, l in given if l == label)  # noqa: E731, E741
    want = {}
    for i, v, _ in given:
        rag, direct = score(v, 0), score(v, 1)
        gap = round(rag - direct, 6)
        want[i] = (rag, direct, "rag" if rag >= 0.2 and gap >= 0.02 else "direct" if direct >= 0.2 and gap <= -0.02 else "none")
    got = {r["vec_id"]: (r["rag_score"], r["direct_score"], r["route"]) for r in registry.QUERIES["anchor_route"](spark, str(tmp_path)).collect()}
    assert {k: v[2] for k, v in got.items()} == {k: v[2] for k, v in want.items()}
    assert all(got[k][:2] == pytest.approx(want[k][:2], abs=2e-6) for k in want)


def test_rescored_pairs_are_not_joined(spark, tmp_path):
    """Orders join vectors, not pairs; a customer whose orders have no key, a vector without customer, a null vector and a customer without vector."""
    given = [(i, [1.0, i / 100]) for i in range(203)] + [(300, None)]
    spark.createDataFrame(given, "vec_id long, embedding array<double>").selectExpr("*", "0 AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    orders = [(7, 1), (3, 1), (None, 2), (9, 100), (5, 300), (6, 999)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    unit = lambda i: [x / math.hypot(1, i / 100) for x in (1.0, i / 100)]
    want = {(q, k, v): sum(x * y for x, y in zip(unit(q), unit(v), strict=True)) for q in (0, 100, 200) for v, k in ((1, 3), (2, None), (100, 9))}
    out = registry.QUERIES["rescore_by_id"](spark, str(tmp_path))
    got = {(r["query_id"], r["ord"], r["vec_id"]): r["score"] for r in out.collect()}
    assert out.columns == ["query_id", "ord", "vec_id", "score"] and got == pytest.approx(want, abs=2e-6)
    above = out._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    assert "Join" not in above


def test_many_edges_are_dealt_finer(spark, calls, monkeypatch):
    """As if four lines were many: more partitions than the session's for lines and scratch tables, the same rows, the session's settings afterwards."""
    names = ["spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    few, before = {n: sorted(map(tuple, registry.QUERIES[n](spark, calls).collect())) for n in ("neighbours", "graph_walks", "edge_lines")}, [spark.conf.get(n) for n in names]
    used = []
    monkeypatch.setattr(scratch, "ROWS", 2)
    monkeypatch.setattr(graph, "pairs", lambda e, f=graph.pairs: used.append(queries._edges(spark, calls).rdd.getNumPartitions()) or f(e))
    assert {n: sorted(map(tuple, registry.QUERIES[n](spark, calls).collect())) for n in few} == few
    assert set(used) == {9} and [spark.conf.get(n) for n in names] == before
    with scratch.finer(spark, 17):
        assert spark.conf.get(names[0]) == "9"


def test_pairs_and_degrees(spark):
    """Calls both ways, repeated, to itself and from or to nothing."""
    given = [(1, 2), (2, 1), (1, 2), (3, 1), (4, 4), (None, 2), (2, None), (5, 6)]
    edges = spark.createDataFrame(given, "caller long, callee long")
    want = collections.Counter(x for e in set(given) for x in e)
    assert {r["id"]: r["degree"] for r in graph.degrees(edges).collect()} == want
    rows = [tuple(r) for r in graph._either_way(graph.pairs(edges)).collect()]
    assert set(rows) == {e for a, b in given for e in ((a, b), (b, a))} and len(rows) == len(set(rows))

"""Walks for many sets, nested templates, dividers, ids and what else is small."""

import hashlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from quillspark.operators import chunking, fusion, graph, lifecycle, search, sessions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_walks_are_those_of_single_sets(spark):
    r = random.Random(2)
    ids = [f"n{i:02d}" for i in range(40)]
    edges = spark.createDataFrame([(r.choice(ids), r.choice(ids[:25])) for _ in range(150)] + [("n00", i) for i in ids], "caller string, callee string")
    nodes = spark.createDataFrame([(i, f"label {i}", f"p{r.randrange(5)}") for i in ids], "id string, label string, path string")
    sets = {k: r.sample(ids, k % 4 + 1) for k in range(12)} | {12: ["n00", "n00", "n01"]}
    seeds = spark.createDataFrame([(k, p, i) for k, own in sets.items() for p, i in enumerate(own)], "set_id int, place int, id string")
    for most, each in ((12, 4), (28, 4), (3, 2)):
        found = graph.walks(edges, nodes, seeds, most, each).cache()
        got = {}
        for x in found.orderBy("set_id", "place").collect():
            got.setdefault(x["set_id"], []).append(x["id"])
        for k, own in list(sets.items())[::4]:
            assert got[k] == graph.relevant(edges, nodes, own, most, each)[0]
    inside = {(x["set_id"], x["caller"], x["callee"]) for x in graph.walked_edges(edges, found).collect()}
    assert inside == {(k, *e) for k, own in got.items() for e in set(map(tuple, edges.collect())) if set(e) <= set(own)}


@pytest.mark.parametrize(("name", "want"), [("Foo<Bar<int>>::run", "Foo::run"), ("a<b<c>, d<e>>.f", "a.f"), ("plain", "plain"), ("x>y", "xy"), ("", "")])
def test_templates(spark, name, want):
    assert one(spark, graph.without_templates(F.lit(name))) == want


def test_dividers():
    """One dash makes a table; only a table with three in each cell is cut by its rows, another one by its words."""
    cut = lambda line: chunking.divides(line, chunking.DASHES)
    assert cut("| --- | :---: |") and cut("---|---:")
    assert not any(map(cut, ("| - | - |", "| -- | --- |", "| --- |", "| :: | --- |", "| --- | a |"))) and chunking.divides("| - | :-: |")
    chunks = lambda line: chunking.Chunker(chunking.char_tokenizer(), 30, 30, 0, 0).chunks(f"| a | b |\n{line}\n" + "| one | two |\n" * 6)
    assert all(c["text"].startswith("| a | b |\n| --- | --- |") for c in chunks("| --- | --- |")[:1]) and not chunks("| - | - |")[1]["text"].startswith("| a | b |")


def test_the_last_title_holds(spark):
    s = spark.createDataFrame([(1, 7, "old"), (2, 8, "old")], "session_id int, user_id int, title string")
    c = spark.createDataFrame([(1, 7, "zebra", 0), (1, 7, "apple", 1), (2, 7, "not mine", 2), (2, 8, None, 3)], "session_id int, user_id int, title string, place int")
    assert {r["session_id"]: r["title"] for r in lifecycle.renamed(s, c).collect()} == {1: "apple", 2: "old"}


def test_ids(spark):
    assert one(spark, lifecycle.document_id(F.lit("b"), F.lit("docs/é.md"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "s3://b/docs/é.md"))
    for given, used in ((("v", "e", "d"), "v"), (("", "e", "d"), "e"), ((None, "", "d"), "d")):
        got = one(spark, lifecycle.chunk_point_id(F.lit("x"), *(F.lit(g).cast("string") for g in given), F.lit(3)))
        assert got == str(uuid.uuid5(uuid.NAMESPACE_URL, f"x:{used}:3"))
    n = one(spark, lifecycle.signature_number([F.lit("a"), F.lit("b")]))
    assert n == int(hashlib.sha256(b"a|b").hexdigest()[:12], 16)


def test_recovery(spark):
    v = spark.createDataFrame([("v1", "c1"), ("v2", "c2"), ("v3", "c2")], "version string, collection string")
    assert (lifecycle.recovered(v, "v1", "c2"), lifecycle.recovered(v, "v1", "c9"), lifecycle.recovered(v, None, "c1")) == ("v3", "v1", "v1")


def test_vectors_of_points_and_tables(spark):
    vectors = lambda **m: F.map_from_entries(F.array(*(F.struct(F.lit(k), F.array(F.lit(x))) for k, x in m.items())))
    assert one(spark, search.point_vector(vectors(default=1.0, other=2.0))) == [1.0] and one(spark, search.point_vector(vectors(other=2.0))) == [2.0] and one(spark, search.point_vector(vectors(a=1.0, b=2.0))) == []
    assert search.missing_tables(["a", "b"], ["a"]) == ["a"]
    with pytest.raises(LookupError, match="missing: c, d"):
        search.missing_tables(["a"], ["d", "a", "c"])


@pytest.mark.parametrize(
    ("files", "explicit", "want"),
    [
        ([("a/x.py", "python")], "mine", ["mine"]),
        ([("go.mod", None), ("a/x.py", "python")], None, ["root"]),
        ([(".git/HEAD", None), ("a/x.py", "python")], None, ["root"]),
        ([("x.cc", "cpp"), ("a/x.py", "python")], None, ["root"]),
        ([("b/src/x.py", "python"), ("A/x.cc", "cpp"), ("c/.venv/x.py", "python"), (".d/x.py", "python"), ("e/readme.md", None)], None, ["A", "b"]),
        ([("a/readme.md", None)], None, ["root"]),
        ([], None, ["root"]),
    ],
)
def test_discovery(spark, files, explicit, want):
    found = lifecycle.discovered(spark.createDataFrame(files, "path string, language string"), "root", explicit)
    assert [r["repository"] for r in found.orderBy("place").collect()] == want
    assert [r["place"] for r in found.orderBy("place").collect()] == list(range(1, len(want) + 1))


def test_search_query_keeps_its_end(spark):
    m = spark.createDataFrame([(1, 0, "user", "x" * 50), (1, 2, "user", "second"), (1, 1, "assistant", "no"), (1, 3, "user", "third")], "conv_id int, turn int, role string, content string")
    q = spark.createDataFrame([(1, " now? "), (2, "alone"), (3, None)], "conv_id int, question string")
    got = {r["conv_id"]: r["search_query"] for r in sessions.search_queries(m, q).collect()}
    assert got == {1: "second\nthird\nnow?", 2: "alone", 3: ""}
    assert {r["search_query"] for r in sessions.search_queries(m, q.filter("conv_id = 1"), n=3, limit=30).collect()} == {"x" * 12 + "\nsecond\nthird\nnow?"}


def test_replies_that_are_wrong(spark):
    c = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "d")], "query_id int, rank int, id string")
    reply = lambda *rows: spark.createDataFrame(list(rows), "query_id int, batch int, results array<struct<index: int, relevance_score: double>>")
    got = lambda r, k=9: [x["id"] for x in fusion.from_replies(c, r, k, 2).orderBy("query_id", "new_rank").collect()]
    good = reply((1, 0, [(1, 0.2), (0, 0.9)]), (1, 1, [(0, 0.9)]), (2, 0, [(0, 0.1)]))
    assert got(good) == ["a", "c", "b", "d"] and got(good, 0) == ["a", "d"]
    assert got(reply((1, 0, [(1, 0.2)]))) == ["b"]
    for bad, why in (((1, 1, [(1, 0.5)]), "out of range"), ((1, 0, [(-1, 0.5)]), "out of range"), ((9, 0, [(0, 0.5)]), "out of range"), ((1, 0, [(None, 0.5)]), "no index"), ((1, 0, [(0, None)]), "no index")):
        with pytest.raises(Exception, match=why):
            fusion.from_replies(c, reply(bad), 9, 2).collect()


def test_few_wanted_names_go_to_the_nodes(spark):
    """Nodes that bear one name are not gathered by it; exact ids come first, repeated nodes count once."""
    rows = [(f"p:{i}", f"a.b{i % 2}.x", f"#{i}") for i in range(6)] * 2 + [("x", "q", "#x2"), ("p:9", "z::y", "#9")]
    nodes = spark.createDataFrame(rows, "id string, label string, name string")
    wanted = spark.createDataFrame([("b0.x",), ("p:1",), ("y",), ("#3",), ("none",)], "wanted string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = graph.matching(nodes, wanted)
        got, plan = sorted(set(map(tuple, out.collect()))), out._jdf.queryExecution().executedPlan().toString()
        assert out.filter("wanted = 'b0.x'").count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [("#3", "p:3"), ("b0.x", "p:0"), ("b0.x", "p:2"), ("b0.x", "p:4"), ("p:1", "p:1"), ("y", "p:9")]
    assert not any("SortMergeJoin" in line and "Inner" in line for line in plan.splitlines())

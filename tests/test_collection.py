"""A stored vector collection against a search through all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators.collection import VectorCollection
from quillspark.sources.snapshots import Snapshots


def brute(rows, asked, k):
    """{query: [(id, score)]} of unit vectors."""
    out = {}
    for q, v in asked:
        scores = sorted(((-round(float(np.dot(v, w)) + 0.0, 6), i) for i, w in rows))[:k]
        out[q] = [(i, -s) for s, i in scores]
    return out


def found(df, key="vec_id"):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r[key], r["score"]))
    return out


def unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


def test_clustered_vectors_spare_most_cells(spark, tmp_path):
    r = np.random.default_rng(1)
    centres = unit(r.normal(size=(40, 12)))
    x = unit(centres[r.integers(0, 40, 1600)] + 0.02 * r.normal(size=(1600, 12)))
    x[500:560] = x[499]  # copies: ties
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)]
    collection = VectorCollection(Snapshots(spark, str(tmp_path / "c")))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert collection.size() is None and collection.ensure(df, 12) and not collection.ensure(df, 12)
    asked = [(i, x[i]) for i in (0, 3, 499, 777, 1500)]
    q = spark.createDataFrame([(i, v.tolist()) for i, v in asked], "query_id long, v array<double>")
    got = collection.search(q, 10)
    assert found(got) == brute(list(enumerate(x)), asked, 10)
    read, cells = got._cells
    assert cells >= 30 and read < cells / 2
    folders = {f.split("cell=")[1].split("/")[0] for f in collection.store.table("vectors").inputFiles()}
    assert len(folders) == cells
    assert found(collection.search(q, 7, F.col("label") == 1)) == brute([(i, v) for i, v in enumerate(x) if i % 3 == 1], asked, 7)
    assert found(collection.search(q, 5000))[3] == brute(list(enumerate(x)), asked, 5000)[3]
    assert collection.search(q.limit(0), 3).count() == 0


def test_unclustered_vectors(spark, tmp_path):
    r = np.random.default_rng(2)
    x = unit(r.normal(size=(300, 24)))
    x[7] = 0
    collection = VectorCollection(Snapshots(spark, str(tmp_path / "c")))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "vec_id long, embedding array<double>")
    collection.build(df, 24)
    asked = [(i, x[i]) for i in range(0, 300, 37)] + [(7, x[7])]
    q = spark.createDataFrame([(i, v.tolist()) for i, v in asked], "query_id long, v array<double>")
    assert found(collection.search(q, 5)) == brute(list(enumerate(x)), asked, 5)


def test_scrolling_and_sizes(spark, tmp_path):
    collection = VectorCollection(Snapshots(spark, str(tmp_path / "c")))
    df = spark.createDataFrame([(i, [1.0, float(i)], f"s{i}") for i in range(25)], "vec_id long, embedding array<double>, source string")
    with pytest.raises(ValueError, match="collection of 3"):
        collection.build(df, 3)
    assert collection.store.active() is None
    collection.build(df, 2)
    seen, after = [], None
    while page := collection.scroll(after, 10).collect():
        seen += [(r["vec_id"], r["source"]) for r in page]
        after = page[-1]["vec_id"]
    assert seen == [(i, f"s{i}") for i in range(25)]
    plan = collection.scroll(3, 5)._jdf.queryExecution().executedPlan().toString()
    assert "v:array" not in plan and "GreaterThan(vec_id,3)" in plan and "v" in collection.scroll(3, 5, vectors=True).columns
    with pytest.raises(ValueError, match="questions"):
        collection.search(spark.createDataFrame([(1, [1.0])], "query_id long, v array<double>"), 1)
    wide = spark.createDataFrame([(1, [1.0, 0.0, 0.0], "x")], "vec_id long, embedding array<double>, source string")
    old = collection.store.active()
    assert collection.ensure(wide, 3) and collection.size() == 3 and collection.store.previous() == old
    collection.build(wide.limit(0), 3)
    assert collection.search(spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id long, v array<double>"), 2).count() == 0

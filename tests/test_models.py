"""Models that callers bring, and the stream of exchanges."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import evaluation, models
from quillspark.streaming import archive, exchanges


def test_options_of_a_task():
    assert models.encode_options("retrieval.query") == {"task": "retrieval", "prompt_name": "query"}
    assert models.encode_options(" retrieval.passage ", "own") == {"task": "retrieval.passage", "prompt_name": "own"}
    assert models.encode_options(None) == {}


def test_texts_are_encoded_in_batches_across_rows(spark):
    rows = spark.createDataFrame([(i, "ab" * i if i else None) for i in range(7)], "id long, t string").coalesce(1)

    def load():
        return lambda texts, **options: [[len(t), len(texts)] for t in texts]

    got = {r["id"]: r["embedding"] for r in models.encoded(rows, "t", load, batch=3, normalize=False).collect()}
    assert [got[i] for i in range(7)] == [[2.0 * i, 1.0 if i == 6 else 3.0] for i in range(7)]
    unit = models.encoded(rows, "t", load).select(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).collect()
    assert all(abs(r[0] - 1) < 1e-9 for r in unit)
    assert models.encoded(rows.limit(0), "t", load).count() == 0


def test_a_model_that_loses_texts_is_an_error(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "t string").coalesce(1)
    with pytest.raises(Exception, match="1 vectors for 2 texts"):
        models.encoded(rows, "t", lambda: lambda texts: [[1.0]]).collect()


def test_routes_by_model(spark):
    replies = ['<think>x</think><answer>{"use_rag": true}</answer>', '{"use_rag": false}', "no idea", None]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string")
    assert [r[0] for r in rows.orderBy("i").select(models.model_route(F.col("reply"))).collect()] == ["llm_rag", "llm_direct", None, None]
    row = spark.createDataFrame([("q", None, "h" * 5000, "s" * 5000)], "q string, p string, h string, s string")
    text = row.select(models.route_request("About ships.", *(F.col(c) for c in "qphs"))).first()[0]
    assert text.startswith("About ships.\n\nQuestion:\nq\n\nEarlier route:\nNone\n\n")
    assert text.count("h" * 3000) == 1 and "h" * 3001 not in text and len(text.split("Summary:\n")[1]) == 4000


def test_exchanges_get_consecutive_numbers(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    line = '{"session_id": %s, "place": %d, "event_id": "%s", "question": "q", "answer": "a", "title": %s, "summary": %s, "compacted": %d}'
    schema = "session_id long, place long, event_id string, question string, answer string, title string, summary string, compacted long"
    last = spark.createDataFrame([(1, 10, "Ships", "old", 4)], "session_id long, last_seq long, title string, summary string, compacted long")

    def go():
        rows = exchanges.append_stream(spark.readStream.schema(schema).json(str(src)), last)
        rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out).awaitTermination()

    (src / "1.json").write_text("\n".join([line % (1, 2, "b", '"no"', '"new"', -3), line % (1, 1, "a", "null", "null", 2), line % (2, 1, "c", "null", "null", 0), line % ("null", 1, "x", "null", "null", 0)]))
    go()
    (src / "2.json").write_text("\n".join([line % (2, 2, "d", '" My   harbour "', '"s"', 1), line % (1, 3, "e", "null", "null", 0)]))
    go()
    got = [tuple(r) for r in spark.read.parquet(out).orderBy("session_id", "seq").select("session_id", "event_id", "seq", "title", "summary", "compacted").collect()]
    assert [g[1:3] for g in got if g[0] == 1] == [(f"{e}:{w}", 11 + 2 * i + j) for i, e in enumerate("abe") for j, w in enumerate(("user", "assistant"))]
    assert [g[3:] for g in got if g[0] == 1][::2] == [("Ships", "old", 6), ("Ships", "new", 6), ("Ships", "new", 6)]
    assert [g[2:] for g in got if g[0] == 2][1:3] == [(2, "New chat", "", 0), (3, "My harbour", "s", 1)]


def test_batches_read_their_own_folders(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    line = '{"event_id": "%s", "session_id": %d, "seq": 1, "role": "user", "content": "x"}'
    (src / "1.txt").write_text("\n".join(line % (f"e{i}", i) for i in range(50)))
    sessions = spark.range(50).select(F.col("id").alias("session_id"))
    for name in ("c1", "c2"):
        archive.archive_stream(spark.readStream.text(str(src)), sessions, out, str(tmp_path / "dead"), str(tmp_path / name)).awaitTermination()
    rows = spark.read.parquet(out)
    assert rows.count() == 50 and rows.filter(F.col("bucket") != archive.bucket(F.col("session_id"))).count() == 0


def test_exact_points_of_hot_keys(spark):
    import numpy as np
    import pandas as pd

    r = np.random.default_rng(3)
    parts = {"hot": np.r_[r.lognormal(size=5000), np.full(700, 2.5)], "ties": np.full(40, 7.0), "one": np.array([-1.0]), "two": np.array([4.0, -9.0]), None: r.integers(-5, 5, 99) * 1.0}
    data = [(k, float(v)) for k, vs in parts.items() for v in vs] + [("none", None), ("hot", None)]
    rows = spark.createDataFrame(data, "k string, v double")
    got = {x["k"]: x for x in evaluation.latencies(rows, "k", "v").collect()}
    assert len(got) == 6 and got["none"]["n"] == 0 and got["none"]["p50"] is None
    for k, vs in parts.items():
        assert got[k]["n"] == len(vs)
        assert [got[k][c] for c in ("p50", "p95", "p99")] == pytest.approx(np.percentile(vs, [50, 95, 99]).tolist(), abs=2e-6)
    at = {x["k"]: x for x in evaluation.index_percentile(rows, "k", "v", 0.95).collect()}
    for k, vs in parts.items():
        assert at[k]["p"] == np.sort(vs)[min(int(len(vs) * 0.95), len(vs) - 1)] and at[k]["median"] == pytest.approx(float(pd.Series(vs).median()), abs=2e-6)
    assert evaluation.latencies(rows.limit(0), "k", "v").count() == evaluation.index_percentile(rows.limit(0), "k", "v", 0.5).count() == 0

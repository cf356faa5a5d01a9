"""Snapshots, accounts, settings and small functions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quillspark.functions import misc
from quillspark.operators import accounts, lexical, sessions
from quillspark.operators.stored import StoredIndex
from quillspark.settings import Settings, from_environment
from quillspark.sources import files
from quillspark.sources.snapshots import Snapshots


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "index"))
    (tmp_path / "index").mkdir()
    for k, v in enumerate(("v1", "v2", "v3")):
        s.build(v, {"docs": spark.range(k + 1)}, {"k": k})
        s.switch(v)
    assert s.active() == "v3" and s.table("docs").count() == 3 and s.is_current({"k": 2}) and not s.is_current({"k": 1})
    assert s.rollback() == "v2" and s.table("docs").count() == 2
    with pytest.raises(RuntimeError):
        s.switch("v3", expected="v1")
    with pytest.raises(ValueError):
        s.switch("v9")
    assert s.prune(2) == ["v1"] and s.versions() == ["v3", "v2"] and s.prune(1) == ["v3"]


def test_stored_index(spark, tmp_path):
    def broken():
        raise OSError("no manifest")

    store = Snapshots(spark, str(tmp_path / "bm25"))
    index = StoredIndex(store, "doc_id", buckets=4)
    docs = spark.createDataFrame([(1, "red red fox"), (2, "blue fox"), (3, None), (4, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "red Fox fox")], "q long, text string")
    first = index.ensure([broken, lambda: docs], lambda: "a")
    assert index.ensure([broken], lambda: "a") == first and store.candidate() is None
    want = lexical.top(lexical.scores(lexical.postings(docs, "doc_id"), asked, "doc_id", "q"), "q", "score", "doc_id", 2)
    row = ["q", "doc_id", "score", "rank"]
    assert sorted(map(tuple, index.search(asked, "q", 2).select(row).collect())) == sorted(map(tuple, want.select(row).collect()))
    assert store.table("stats").first()["corpus"] == 2 and index.search(asked.limit(0), "q", 2).count() == 0
    states = iter("bc")
    with pytest.raises(RuntimeError, match="changed"):
        index.rebuild([lambda: docs], lambda: next(states))
    with pytest.raises(RuntimeError, match="is active"):
        index.rebuild([lambda: docs], lambda: "b", expected="other")
    with pytest.raises(OSError):
        index.ensure([broken], lambda: "b")
    assert store.active() == first and store.versions() == [first] and store.candidate() is None
    store.prepare("next")
    with pytest.raises(RuntimeError, match="being prepared"):
        index.ensure([lambda: docs], lambda: "b")
    store.activate(first)
    with pytest.raises(RuntimeError, match="not prepared"):
        store.activate("other")
    store.discard("next")
    assert index.ensure([lambda: docs], lambda: "b") != first and store.previous() == first


def test_request_batches(spark):
    rows = [("a", 0.0), ("a", 0.001), ("a", 0.002), ("a", 0.003), ("a", 0.004), ("a", 0.005), ("b", 0.0), ("a", 1.0)]
    got = accounts.request_batches(spark.createDataFrame(rows, "task string, at double"), ["task"], 4, 0.02)
    sizes = sorted((r["task"], r["batch"], r["count"]) for r in got.groupBy("task", "batch").count().collect())
    assert sizes == [("a", 0, 4), ("a", 1, 2), ("a", 2, 1), ("b", 0, 1)]


def test_selection_and_guards(spark):
    repos = spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string")
    assert accounts.selected(repos, ["1", " y ", "y"], "id", "name").count() == 2
    with pytest.raises(ValueError, match="q, z"):
        accounts.selected(repos, ["z", "x", "q"], "id", "name")
    users = spark.createDataFrame([(1, True, True, False), (2, False, True, False), (3, True, True, True)], "id int, is_admin boolean, is_active boolean, is_superuser boolean")
    assert {r["id"]: r["may_demote"] for r in accounts.may_demote(users).collect()} == {1: True, 2: True, 3: False}
    rows = spark.createDataFrame([("en", None), ("de", "h")], "lang string, h1 string")
    assert accounts.metadata_filter(rows, {"lang": "en", "h1": "", "gone": None}).count() == 1
    assert accounts.metadata_filter(rows, {"gone": "x"}).count() == 0


def test_small_functions(spark):
    one = spark.createDataFrame([("u:p; V.x : q:r ,\n", "pw", "00ff", "")], "raw string, pw string, salt string, none string")
    got = one.select(
        misc.bootstrap_users(F.col("raw")).alias("users"), misc.password_hash(F.col("pw"), F.col("salt"), 1000).alias("hash"), misc.backoff(0.5, 3.0, 4).alias("delays"), misc.moment(F.lit("2024-01-02T03:04:05")).alias("at"), misc.moment(F.col("none")).alias("no"),
        misc.search_result({"source": F.lit("s"), "score": F.lit(0.5)}).alias("json"), misc.messages(F.lit("sys"), F.lit(""), F.lit(None).cast("array<struct<role: string, content: string>>"), F.lit("q")).alias("m"),
    ).first()
    assert [tuple(u) for u in got["users"]] == [("u", "p"), ("v.x", "q:r")]
    assert got["hash"] == hashlib.pbkdf2_hmac("sha256", b"pw", bytes.fromhex("00ff"), 1000).hex()
    assert got["delays"] == [0.5, 1.0, 2.0, 3.0] and got["at"].hour == 3 and got["no"] is None
    assert '"chunk_id":-1' in got["json"] and '"content_type":"text"' in got["json"] and [x["role"] for x in got["m"]] == ["system", "user"]
    a = one.select(misc.config_digest(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))).alias("d")).first()["d"]
    assert a == one.select(misc.config_digest(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))).alias("d")).first()["d"]


def test_settings():
    assert from_environment(env={"QUILL_ROUTER_ENABLED": "Off", "QUILL_FINAL_TOP_K": "7"}) == Settings(router_enabled=False, final_top_k=7)
    assert Settings(rrf_top_k=3, final_top_k=5).fused_k == 5
    for bad in ({"final_top_k": 21}, {"chunk_target_tokens": 2000}, {"bm25_top_k": 0}, {"vector_top_k": 1001}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_the_rest_stands_without_the_training_operators(tmp_path):
    """With the subpackage and the pipeline gone, the entry module still offers the other queries."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "quillspark"), tmp_path / "quillspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 60 and not any(n.startswith('op') for n in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_code_files_with_other_bytes(spark, tmp_path):
    (tmp_path / "a.py").write_bytes(b"x = 'caf\xe9'\ny = 1\n")
    (tmp_path / "b.cc").write_text("int é;")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.code(spark, str(tmp_path), "r").collect()}
    assert rows["a.py"]["full_content"] == "x = 'caf�'\ny = 1\n" and rows["a.py"]["line_count"] == 2 and rows["b.cc"]["full_content"] == "int é;"


def test_a_replay_lifts_a_lagging_sequence(spark):
    rows = spark.createDataFrame([("a-1", 7, 1, "user"), ("a-2", 7, 2, "assistant")], "event_id string, session_id long, seq long, role string")
    known = spark.createDataFrame([(7, 0), (8, 4)], "session_id long, archive_seq long")
    archived, moved = sessions.archive(rows, rows, known)
    assert archived.count() == 2 and {r["session_id"]: r["archive_seq"] for r in moved.collect()} == {7: 2, 8: 4}

"""Incremental ingest in two phases, and vectors that are encoded once."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import chunking, decisions, lexical
from quillspark.operators.ingest import DocumentIndex
from quillspark.operators.vector_cache import VectorCache
from quillspark.sources.snapshots import Snapshots

RECORD = "source_doc_id string, key string, source string, version_id string, etag string, size long, content_hash string, text string"


def records(spark, texts):
    """{source: (version, text)} as records."""
    rows = [(f"id-{s}", f"docs/{s}", s, v, f"e-{v}", len(t), f"h-{t}", t) for s, (v, t) in texts.items()]
    return spark.createDataFrame(rows, RECORD)


def made(spark, root, calls, **more):
    cache = VectorCache(spark, f"{root}/vectors")

    def load():
        def model(texts, **options):
            with open(calls, "a") as f:
                f.writelines(f"{t!r}\n" for t in texts)
            return [[float(len(t)), 1.0] for t in texts]

        return model

    chunk = lambda d: chunking.chunked(d, "source_doc_id", chunking.char_tokenizer, 160, 200, 20, 20)
    encode = lambda c: cache.encoded(c, "embedding_text", load, "m")
    index = DocumentIndex(Snapshots(spark, f"{root}/index"), chunk, encode, {"target": 160}, derive={"postings": lambda c: lexical.postings(c.withColumn("k", F.concat_ws(":", "source_doc_id", "chunk_id")), "k")}, retain=2, **more)
    return index, cache


def sources(index, version=None):
    return sorted(r["source_doc_id"] for r in index.chunks(version).collect())


TEXT = lambda d: d.select("source_doc_id", "text")


def counts(r):
    return r.added, r.modified, r.deleted, r.unchanged, r.copied_chunks, r.embedded_chunks, r.total_chunks


def test_three_steps(spark, tmp_path):
    calls = tmp_path / "calls"
    index, cache = made(spark, str(tmp_path), calls)
    one = {"a.md": ("a1", "# A\n\nalpha orphan text"), "b.md": ("b1", "# B\n\nbeta stable text"), "c.md": ("c1", "# C\n\ncharlie old text")}
    first = index.ingest(records(spark, one), TEXT)
    assert counts(first) == (3, 0, 0, 0, 0, 3, 3) and index.store.active() == first.version
    two = {"b.md": one["b.md"], "c.md": ("c2", "# C\n\ncharlie modified text"), "d.md": ("d1", "# D\n\ndelta new text")}
    assert counts(index.ingest(records(spark, two), TEXT, dry_run=True)) == (1, 1, 1, 1, 0, 0, 0) and index.store.active() == first.version
    before = calls.read_text().count("\n")
    second = index.ingest(records(spark, two), TEXT)
    assert counts(second) == (1, 1, 1, 1, 1, 2, 3) and sources(index) == ["id-b.md", "id-c.md", "id-d.md"]
    assert calls.read_text().count("\n") == before + 2 and cache.size("m") == 5
    tokens = {r["token"] for r in index.store.table("postings").collect()}
    assert "orphan" not in tokens and {"delta", "stable", "modified"} <= tokens
    assert sources(index, first.version) == ["id-a.md", "id-b.md", "id-c.md"]  # a reader of the old version goes on
    again = index.ingest(records(spark, two), TEXT)
    assert again.skipped and again.unchanged == 3 and again.total_chunks == 3 and index.store.active() == second.version
    three = two | {"b.md": ("b2", "# B\n\nbeta changed again")}
    third = index.ingest(records(spark, three), TEXT)
    assert counts(third) == (0, 1, 0, 2, 2, 1, 3) and index.store.versions() == [third.version, second.version]
    assert index.segments() == sorted({s for v in index.store.versions() for s in index.store.manifest(v)["segments"]})
    assert index.find(index.store.manifest(second.version)["collection"])["version"] == second.version and index.find("other") is None
    assert index.store.manifest(third.version)["status"] == "active" and index.reconciled()["version"] == third.version


def test_sparse_segments_are_written_anew_without_the_model(spark, tmp_path):
    calls = tmp_path / "calls"
    index, _ = made(spark, str(tmp_path), calls)
    texts = {f"{i}.md": ("v1", f"# T{i}\n\ntext {i}") for i in range(10)}
    first = index.ingest(records(spark, texts), TEXT)
    less = {s: t for s, t in texts.items() if s < "3"}
    n = calls.read_text().count("\n")
    found = index.ingest(records(spark, less), TEXT)
    assert counts(found) == (0, 0, 7, 3, 3, 0, 3) and calls.read_text().count("\n") == n
    assert index.store.manifest(found.version)["segments"] == {found.version: 3} and sources(index) == [f"id-{s}" for s in sorted(less)]
    assert index.chunks().filter("embedding is null").count() == 0 and sources(index, first.version) == sorted(f"id-{s}" for s in texts)
    none = index.ingest(records(spark, {}), TEXT)
    assert counts(none) == (0, 0, 3, 0, 0, 0, 0)
    back = index.ingest(records(spark, less), TEXT)
    assert counts(back) == (3, 0, 0, 0, 0, 3, 3) and calls.read_text().count("\n") == n  # their vectors are known


def test_a_new_configuration_does_all_anew(spark, tmp_path):
    index, _ = made(spark, str(tmp_path), tmp_path / "calls")
    texts = {"a": ("1", "one"), "b": ("1", "two"), "empty": ("1", "")}
    assert counts(index.ingest(records(spark, texts), TEXT)) == (3, 0, 0, 0, 0, 2, 2)
    index.config = {"target": 161}
    found = index.ingest(records(spark, texts), TEXT)
    assert counts(found) == (3, 0, 0, 0, 0, 2, 2) and sources(index) == ["id-a", "id-b"]
    assert counts(index.ingest(records(spark, texts), TEXT, recreate=True))[:4] == (3, 0, 0, 0)


def test_failures_leave_the_active_version(spark, tmp_path):
    index, _ = made(spark, str(tmp_path), tmp_path / "calls")
    first = index.ingest(records(spark, {"a": ("1", "one")}), TEXT)
    more = records(spark, {"a": ("1", "one"), "b": ("1", "two")})

    def broken(d):
        raise OSError("texts are away")

    with pytest.raises(OSError):
        index.ingest(more, broken)
    assert index.store.active() == first.version and index.store.candidate() is None and index.segments() == [first.version]
    prepared = index.prepare(more, TEXT)
    with pytest.raises(RuntimeError, match="being prepared"):
        index.prepare(more, TEXT)
    index.prune(1)
    assert sources(index, prepared.version) == ["id-a", "id-b"]  # pruning spares the candidate
    lost = index.store.manifest(prepared.version)
    index._say(lost, dead=0, segments={prepared.version: 1})
    with pytest.raises(RuntimeError, match="chunks, not"):
        index.commit(prepared)
    index._say(lost)
    with pytest.raises(RuntimeError, match="not ready"):
        index.commit(type(prepared)("v9", first.version))
    assert index.commit(prepared) and not index.commit(prepared) and sources(index) == ["id-a", "id-b"]
    late = index.prepare(records(spark, {}), TEXT)
    index.store.switch(first.version)
    with pytest.raises(RuntimeError, match="is active"):
        index.commit(late)
    index.discard(late.version)
    assert index.store.versions() == [prepared.version, first.version]


def test_of_two_writers_one_switches(spark, tmp_path):
    one, two = (Snapshots(spark, str(tmp_path / "s")) for _ in range(2))
    for v in ("a", "b", "c"):
        one.build(v, {"t": spark.range(1)}, {})
    one.switch("a")
    seen = two._pointer()
    two._pointer = lambda: seen  # it has read the pointer before the other one moves it
    one.switch("b")
    with pytest.raises(RuntimeError, match="another writer"):
        two.switch("c")
    assert one.active() == "b"
    one.prepare("d")
    with pytest.raises(RuntimeError, match="being prepared"):
        two.prepare("e")
    one.prepare("d")


def test_vectors_are_encoded_once(spark, tmp_path):
    calls = tmp_path / "calls"
    cache = VectorCache(spark, str(tmp_path / "v"))

    def load():
        def model(texts, **options):
            with open(calls, "a") as f:
                f.writelines("x" for _ in texts)
            return [[float(len(t)), float(len(options))] for t in texts]

        return model

    rows = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, None), (4, ""), (5, "bbbb")], "i int, t string").withColumn("embedding", F.lit(7)).withColumn("digest", F.lit("d"))
    for _ in range(2):
        out = cache.encoded(rows, "t", load, "m", normalize=False)
        assert {r["i"]: r["embedding"][0] for r in out.collect()} == {1: 2.0, 2: 2.0, 3: 0.0, 4: 0.0, 5: 4.0} and set(out.columns) == set(rows.columns)
        assert len(calls.read_text()) == 3
    other = cache.encoded(rows, "t", load, "m", task="retrieval.query", normalize=False)
    assert {r["embedding"][1] for r in other.collect()} == {2.0} and len(calls.read_text()) == 6
    assert (cache.size("m", normalize=False), cache.size("m", task="retrieval.query", normalize=False), cache.size("m")) == (3, 3, 0)
    assert cache.encoded(rows.limit(0), "t", load, "m", normalize=False).count() == 0


def test_routes_encode_anchors_and_questions_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.write_text("")

    def load():
        def model(texts, **options):
            with open(calls, "a") as f:
                f.writelines("x" for _ in texts)
            return [[1.0, 0.0] if "doc" in t else [0.0, 1.0] if "joke" in t else [1.0, 1.0] for t in texts]

        return model

    cache = VectorCache(spark, str(tmp_path / "v"))
    anchors = spark.createDataFrame([("rag", "find docs"), ("direct", "tell a joke")], "kind string, text string")
    rows = [(1, "where is the doc for it", None), (2, "one joke for me", None), (3, "neither of them", '{"use_rag": true}'), (4, "neither of them", '{"use_rag": false}'), (5, "neither of them", None)]
    asked = spark.createDataFrame([(i, t, t, False, False, r) for i, t, r in rows], "i int, question string, text string, used_rag boolean, had_contexts boolean, reply string")
    for _ in range(2):
        got = {r["i"]: r["route"] for r in decisions.decided(asked, "i", anchors, cache, load, "m", []).collect()}
        assert got == {1: "embedding_rag", 2: "embedding_direct", 3: "llm_rag", 4: "llm_direct", 5: "fallback_rag"}
        assert len(calls.read_text()) == 5  # two anchors, three distinct texts


def test_texts_of_changed_documents_are_not_shuffled(spark, tmp_path):
    """Keys of a few changed documents go to the texts, whatever the session's threshold."""
    index, _ = made(spark, str(tmp_path), tmp_path / "calls")
    one = {f"{i}.md": ("v1", f"# H\n\ntext {i}") for i in range(6)}
    index.ingest(records(spark, one), TEXT)
    now = records(spark, one | {"0.md": ("v2", "# H\n\nother"), "9.md": ("v1", "# H\n\nnew")})
    plans, name = [], "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)

    def texts(new):
        found = TEXT(now).join(new.select("source_doc_id"), "source_doc_id", "left_semi")
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    spark.conf.set(name, -1)
    try:
        assert counts(index.ingest(now, texts)) == (1, 1, 0, 5, 5, 2, 7)
    finally:
        spark.conf.set(name, before)
    assert len(plans) == 1 and "BroadcastHashJoin" in plans[0]

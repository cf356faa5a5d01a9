"""Operators on small rows made for one property each."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import chunking, code, dml, fusion, graph, routing, sessions, versions
from quillspark.sources import files
from quillspark.streaming import archive


def make(target, most, overlap=0, overlap_most=0, tokenizer=chunking.char_tokenizer):
    return chunking.Chunker(tokenizer(), target, most, overlap, overlap_most)


def test_chunks_keep_kinds_and_headings():
    doc = "# One\n\nSome words here.\n\n## Two\n\n```python\nx = 1\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n"
    got = make(120, 120, 30, 30).chunks(doc)
    assert [c["content_type"] for c in got] == ["text", "code", "table"]
    assert got[1]["text"].startswith("```python") and got[1]["text"].endswith("```")
    assert got[2]["h1"] == "One" and got[2]["h2"] == "Two" and all("#" not in c["text"] for c in got)


def test_overlap_stays_in_section_and_budget():
    part = " ".join(f"Sentence number {i} is here." for i in range(12))
    got = make(100, 120, 40, 50).chunks(f"# T\n\n## A\n\n{part}\n\n## B\n\n{part}")
    assert len(got) >= 6 and all(c["tokens"] <= 220 for c in got)
    assert {c["h2"] for c in got} == {"A", "B"} and any(c["prefix_tokens"] for c in got)


def test_front_matter_lines():
    got = make(400, 520).chunks("---\nid: 7\ntitle: Name\nsource: x\n---\n\nFirst part.\n\nSecond part.\n")
    assert len(got) == 1 and got[0]["h1"] == "Name" and (got[0]["start_line"], got[0]["end_line"]) == (7, 9)


def test_long_tables_and_fences_repeat_their_wrapping():
    table = "| k | v |\n|---|---|\n" + "\n".join(f"| {i} | value {i} |" for i in range(30))
    got = make(90, 90).chunks(table)
    assert len(got) > 3 and all(c["text"].startswith("| k | v |\n|---|---|") and c["tokens"] <= 90 for c in got)
    fence = "```\n" + "\n".join(f"line {i}" for i in range(40)) + "\n```"
    assert all(c["text"].startswith("```\n") and c["text"].endswith("\n```") for c in make(60, 60).chunks(fence))


def test_word_tokens_bound_chunks():
    got = make(16, 16, tokenizer=chunking.word_tokenizer).chunks(" ".join(f"longword{i}" for i in range(50)))
    assert all(c["body_tokens"] <= 16 for c in got) and sum(c["body_tokens"] for c in got) == 50
    with pytest.raises(ValueError):
        make(0, 10)


def test_cjk_tokens_and_estimate(spark):
    df = spark.createDataFrame([("Ab 中文字 x_1",), (None,), ("",)], "text string")
    got = [r[0] for r in df.select(T.lexical_tokens(F.col("text"))).collect()]
    assert got[0] == ["ab", "x_1", "中", "文", "字", "中文", "文字"] and got[1] == [] and got[2] == []
    assert [r[0] for r in df.select(T.token_estimate(F.col("text"))).collect()] == [3 + 2, 0, 0]


def test_uuid5(spark):
    import uuid

    name = "docs:17"
    assert spark.range(1).select(T.name_uuid(T.URL_NAMESPACE, F.lit(name))).first()[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_fusion_order(spark):
    v = spark.createDataFrame([(1, "s", 1, 0.9, 1), (1, "s", 2, 0.8, 2)], "query_id int, source string, chunk_id int, score double, rank int")
    b = spark.createDataFrame([(1, "s", 2, 4.0, 1), (1, "s", 3, 3.0, 2)], "query_id int, source string, chunk_id int, score double, rank int")
    got = fusion.fused(v, b, 2).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [2, 1] and got[0]["retrieval_source"] == "hybrid"
    assert fusion.degraded(v, b, 1, bm25_ok=True, vector_ok=False).count() == 2
    assert fusion.degraded(v, b, 1, bm25_ok=False, vector_ok=True).count() == 1
    with pytest.raises(RuntimeError):
        fusion.degraded(v, b, 1, False, False)


def test_routes(spark):
    cases = [("please do not use rag here", "keyword_direct"), ("search the docs for sql", "keyword_rag"), ("write me a short poem", "keyword_direct"), ("what is postgres", "keyword_direct"), ("tell me more", "state_rag"), ("something else", "fallback_rag"), ("about carp", "keyword_rag"), ("sparkle", "fallback_rag")]
    df = spark.createDataFrame(cases, "q string, want string")
    for r in df.select("want", routing.route(F.col("q"), F.lit(True), F.lit(True), ["carp"]).alias("got")).collect():
        assert r["got"] == r["want"]
    replies = [('<answer>{"use_rag": "true"}</answer>', True), ("it is False", False), ("true or false", None), ('{"use_rag": false}', False), ('{"other": true}', None)]
    df = spark.createDataFrame(replies, "r string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", routing.verdict(F.col("r")).alias("got")).collect())


def test_hysteresis(spark):
    df = spark.createDataFrame([(0, i, ok) for i, ok in enumerate([False, False, True, True])], "k int, i int, ok boolean")
    got = [r["degraded"] for r in sessions.hysteresis(df, "k", ["i"]).orderBy("i").collect()]
    assert got == [False, True, True, False]


def test_retention_keeps_a_usable_version(spark):
    rows = [("k", 4, True), ("k", 3, True), ("k", 2, False), ("k", 1, False)]
    df = spark.createDataFrame(rows, "key string, v int, deleted boolean")
    got = {r["v"] for r in versions.retained(df, "key", [F.desc("v")], 2).filter("kept").collect()}
    assert got == {4, 2}


def test_batch_insert_fails_whole(spark):
    t = spark.createDataFrame([(1, "a")], "id int, n string")
    assert dml.insert_all_or_none(t, spark.createDataFrame([(2, "b")], t.schema), ["id"]).count() == 2
    for bad in ([(1, "x")], [(3, "x"), (3, "y")]):
        with pytest.raises(ValueError):
            dml.insert_all_or_none(t, spark.createDataFrame(bad, t.schema), ["id"])


PYTHON = 'class C:\n    """About."""\n\n    def m(self):\n        return helper(1)\n\n\ndef helper(x):\n    return x\n'
CPP = "namespace n {\nclass Foo : public Base {\n public:\n  void Run() { Bar(); }\n};\nvoid Configure(int a) {\n  if (a) { helper(a); }\n}\n}\nvoid Foo::Stop() { Run(); }\n"


def test_symbols(spark):
    rows = [("r", "a.py", "python", PYTHON), ("r", "a.cc", "cpp", CPP), ("r", "bad.py", "python", "def (")]
    df = spark.createDataFrame(rows, "repository_id string, path string, language string, full_content string")
    got = {(r["path"], r["qualified_name"]): r for r in code.symbols(df).collect()}
    assert set(got) == {("a.py", "C"), ("a.py", "C.m"), ("a.py", "helper"), ("a.cc", "Foo"), ("a.cc", "Foo::Run"), ("a.cc", "Configure"), ("a.cc", "Foo::Stop")}
    assert [c["callee"] for c in got["a.py", "C.m"]["calls"]] == ["helper"] and [c["callee"] for c in got["a.cc", "Foo::Run"]["calls"]] == ["Bar"]
    assert got["a.py", "C"]["docstring"] == "About." and got["a.py", "C.m"]["start_line"] == 4


def test_call_resolution(spark):
    nodes = spark.createDataFrame([("1", "r", "C.m", "a.py"), ("2", "r", "helper", "a.py"), ("3", "r", "helper", "b.py"), ("4", "r", "C.n", "a.py")], "id string, repo string, qualified string, path string")
    calls = spark.createDataFrame([("r", "C.m", "helper", "a.py"), ("r", "C.m", "self.n", "a.py"), ("r", "x", "nothing", "a.py"), ("r", "x", "obj->n", "z.py")], "repo string, caller string, callee string, path string")
    nodes = nodes.filter("id <> '3'").unionByName(nodes.filter("id = '3'").withColumn("qualified", F.lit("other.helper")))
    got = {r["callee"]: r["target"] for r in graph.resolved(calls, nodes).collect()}
    assert got == {"helper": "2", "self.n": "4", "obj->n": "4"}


def test_chain_survives_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")], "caller string, callee string")
    nodes, edges = graph.chain(e, spark.createDataFrame([("a",)], "id string"), 2)
    assert {r["id"]: r["depth"] for r in nodes.collect()} == {"a": 0, "b": 1, "c": 2} and edges.count() == 3
    about = spark.createDataFrame([(x, x, "p") for x in "abcd"], "id string, label string, path string")
    assert graph.relevant(e, about, ["a"], 3)[0] == ["a", "b", "c"]


def test_user_lists(spark):
    lines = lambda *x: spark.createDataFrame(list(enumerate(x, 1)), "line int, value string")
    assert files.user_list(lines("\ufeffemail,passwd", "a@b, secret")).collect()[0]["passwd"] == "secret"
    for bad in (("mail,passwd", "a,b"), ("email,passwd", "a,b,c"), ("email,passwd", "a"), ("email,passwd", "a,"), ("email,passwd",)):
        with pytest.raises(ValueError):
            files.user_list(lines(*bad))


def test_file_sources(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "x.md").write_text("# hi\n")
    (tmp_path / "d" / "y.PY").write_text("a = 1\n")
    (tmp_path / "d" / "z.txt").write_text("no")
    docs = files.markdown(spark, str(tmp_path))
    assert docs.count() == 1 and len(files.signature(docs).first()[0]) == 64
    assert [(r["language"], r["line_count"]) for r in files.code(spark, str(tmp_path), "r").collect()] == [("python", 1)]
    files.write_json(spark, {"documents": [{"source_doc_id": "1", "key": "k", "source": "s"}, {"source_doc_id": "", "key": "k", "source": "s"}]}, str(tmp_path / "m.json"))
    assert files.read_manifest(spark, str(tmp_path / "m.json")).count() == 1


def test_stream_archives_once(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    line = '{"event_id": "%s", "session_id": %d, "seq": %d, "role": "user", "content": "x"}'
    (src / "1.txt").write_text("\n".join([line % ("a", 1, 1), line % ("b", 1, 2), line % ("a", 1, 1), "broken", line % ("z", 9, 1)]))
    sessions_ = spark.createDataFrame([(1,)], "session_id long")

    def go(name):
        stream = spark.readStream.text(str(src))
        archive.archive_stream(stream, sessions_, out, str(tmp_path / "dead"), str(tmp_path / name)).awaitTermination()

    go("c1")
    (src / "2.txt").write_text("\n".join([line % ("c", 1, 3), line % ("d", 1, 2)]))
    go("c1")
    go("c2")  # a lost checkpoint replays everything
    got = sorted((r["event_id"], r["seq"]) for r in spark.read.parquet(out).collect())
    assert got == [("a", 1), ("b", 2), ("c", 3)]
    assert spark.read.parquet(str(tmp_path / "dead")).filter("value = 'broken'").count() >= 1


def test_windowed_counts(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    assert archive.windowed_counts(e).agg(F.sum("n")).first()[0] == e.count()


def test_code_index_is_replaced_by_file(spark):
    files_ = spark.createDataFrame([("f1", "r", "a.py"), ("f2", "r", "b.py")], "file_id string, repository_id string, path string")
    functions = spark.createDataFrame([("x", "f1"), ("y", "f2")], "id string, file_id string")
    edges = spark.createDataFrame([("x", "y"), ("y", "x")], "function_id string, callee string")
    new = (spark.createDataFrame([("f9", "r", "a.py")], files_.schema), spark.createDataFrame([("z", "f9")], functions.schema), spark.createDataFrame([("z", "y")], edges.schema))
    a, b, c = dml.replace_files(files_, functions, edges, *new)
    assert sorted(r["file_id"] for r in a.collect()) == ["f2", "f9"] and sorted(r["id"] for r in b.collect()) == ["y", "z"]
    assert sorted(r["function_id"] for r in c.collect()) == ["y", "z"]


def test_markdown_blocks():
    """Top-level blocks alone: lists, quotes, HTML and indented code whole, headings in them without effect."""
    text = "# A\n\n- one\n  # no heading\n\n  more\n- two\n\n> quote\n> # neither\n\n<div>\nx\n</div>\n\n    code\n\n    code\n\n***\n\n1. n\n2. m\n\nlast\n- at once\n"
    got = [(p.text.split("\n")[0], p.headings, p.first, p.last) for p in chunking.blocks(text)]
    h = ((1, "A"),)
    assert got == [("- one", h, 3, 7), ("> quote", h, 9, 10), ("<div>", h, 12, 14), ("code", h, 16, 18), ("***", h, 20, 20), ("1. n", h, 22, 23), ("last", h, 25, 25), ("- at once", h, 26, 26)]
    table = list(chunking.blocks("a | b\n:-- | --:\n1 | 2\n\nx | y"))
    assert [(p.kind, p.text) for p in table] == [("table", "a | b\n:-- | --:\n1 | 2"), ("text", "x | y")]
    assert not chunking.divides("---") and chunking.divides("|:-:|-|") and not chunking.divides("a | -")


def test_front_matter():
    lines, meta, taken = chunking.front_matter("---\ntitle: \"T: x\"\ntags:\n  - a\n  - b\n---\nbody")
    assert (lines, meta["title"], taken) == (["body"], "T: x", 6)
    for text in ("---\n- a\n- b\n---\nbody", "---\nno end", "---\nplain words\n---\nbody"):
        assert chunking.front_matter(text) == (text.splitlines(), {}, 0)


def test_wrapped_parts_fit_and_hold_every_line():
    fence = "```py\n" + "\n".join(f"line {i} " + "x" * (i * 7 % 40) for i in range(60)) + "\n" + "y" * 300 + "\n```"
    got = make(90, 100).chunks(fence)
    assert all(c["content_type"] == "code" and c["tokens"] <= 100 and c["text"].startswith("```py\n") and c["text"].endswith("\n```") for c in got)
    inner = [x for c in got for x in c["text"].split("\n")[1:-1]]
    assert [x for x in inner if x.startswith("line")] == [f"line {i} " + "x" * (i * 7 % 40) for i in range(60)] and sum(len(x) for x in inner if x.startswith("y")) == 300

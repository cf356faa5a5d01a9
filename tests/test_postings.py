"""Blocks of postings with bounds, against scores of all postings."""

import random

from pyspark.sql import functions as F

from quillspark.operators import lexical, postings
from quillspark.operators.stored import StoredIndex
from quillspark.sources.snapshots import Snapshots

ROW = ["q", "doc_id", "score", "rank"]


def corpus(spark, n=600):
    """Families of documents with words of their own, so that some windows stand out for a question; nulls, empty texts and copies."""
    r = random.Random(4)
    rows = []
    for i in range(n):
        family = [f"f{i // 40}w{j}" for j in range(12)]
        rows.append((f"d{i:04d}", " ".join(r.choice(family + ["the", "of", "a"]) for _ in range(r.randrange(5, 40))), i % 2 == 0))
    rows += [("n1", None, True), ("n2", "", True), ("x1", "f3w1 f3w1 the", True), ("x2", "f3w1 f3w1 the", True), ("x3", "漢字 漢字", None)]
    return spark.createDataFrame(rows, "doc_id string, text string, ok boolean").coalesce(1)


def asked(spark):
    return spark.createDataFrame([(1, "f3w1 the f3w2"), (2, "the of a"), (3, "f7w0 f7w3 f7w3 f9w1"), (4, "unknown"), (5, None), (6, "漢字 the")], "q int, text string")


def rows(df):
    return sorted(map(tuple, df.select(ROW).collect()))


def test_stored_blocks(spark, tmp_path):
    docs, questions = corpus(spark), asked(spark)
    index = StoredIndex(Snapshots(spark, str(tmp_path / "i")), "doc_id", buckets=4, window=16)
    index.ensure([lambda: docs], lambda: "s")
    for k in (1, 50):
        want = lexical.top(lexical.scores(lexical.postings(docs, "doc_id"), questions, "doc_id", "q"), "q", "score", "doc_id", k)
        assert rows(index.search(questions, "q", k)) == rows(want)
    read, every = index.blocks_read(questions.filter("q = 1"), "q", 5)
    assert 0 < read < every / 2  # "the" is in all windows, of which few can matter
    none = index.search(questions.filter("q > 3 and q < 6"), "q", 5)
    assert none.count() == 0


def test_blocks_made_for_one_search(spark, monkeypatch):
    docs, questions = corpus(spark, 300), asked(spark)
    terms = lexical.asked_tokens(questions, "q")
    index = lexical.postings(docs, "doc_id")
    want = lexical.scores(index, questions, "doc_id", "q")
    for size, together in ((7, 200_000), (1024, 2)):
        monkeypatch.setattr(postings, "TOGETHER", together)  # with 2, questions come in lots and blocks are made of all tokens
        made = postings.blocks(docs, "doc_id", only=terms, size=size)
        stats = postings.statistics(made)
        assert stats[0] == lexical.statistics(index, "doc_id").first()["n_docs"]
        found = postings.best(made, terms, "q", 9, *stats, postings.frequencies(made)).withColumnRenamed("key", "doc_id")
        assert rows(found) == rows(lexical.top(want, "q", "score", "doc_id", 9))
    some = postings.blocks(docs, "doc_id", only=terms, wanted=F.col("ok"), size=16)
    found = postings.best(some, terms, "q", 9, *stats, postings.frequencies(some)).withColumnRenamed("key", "doc_id")
    assert rows(found) == rows(lexical.top(want.join(docs.filter("ok").select("doc_id"), "doc_id", "left_semi"), "q", "score", "doc_id", 9))
    empty = postings.blocks(docs.limit(0), "doc_id", only=terms)
    assert postings.statistics(empty) == (0, 1.0) and postings.best(empty, terms, "q", 3, 0, 1.0, postings.frequencies(empty)).count() == 0


def test_blocks_are_not_shuffled_to_be_left_out(spark):
    """Windows that are to be scored go to the blocks, whatever the session's threshold."""
    docs = spark.createDataFrame([(i, f"alpha w{i % 3}") for i in range(40)], "doc_id long, text string").coalesce(1)
    asked = lexical.asked_tokens(spark.createDataFrame([(1, "alpha w1")], "item_id long, text string"), "item_id")
    made = postings.blocks(docs, "doc_id", size=8).cache()
    n, mean = postings.statistics(made)
    lot = next(postings.terms(asked, "item_id", postings.frequencies(made), n))
    pairs = spark.createDataFrame([(0, 0), (2, 0)], "window long, q int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = postings.scored(made, lot, "item_id", ("bigint", "bigint"), mean, 100, pairs)
        plan, keys = out._jdf.queryExecution().executedPlan().toString(), {r["key"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        made.unpersist()
    assert keys == {*range(8), *range(16, 24)} and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan

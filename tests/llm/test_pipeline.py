"""The stages of the corpus pipeline, each over what the one before wrote."""

import collections

import corpus_pipeline
from pyspark.sql import functions as F

from quillspark.llm import mixing, rule_ensemble
from quillspark.llm.common import cut
from tests.llm.test_operators import SCHEMA, awkward, brute_components, brute_repeats, words


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    (_, quality), (_, near), (_, repeats), (_, mix), (_, tokens) = corpus_pipeline.STAGES
    one = cut(quality(spark, docs, sf))
    score = {r["doc_id"]: r["score"] for r in rule_ensemble.scored(docs, rule_ensemble.train(docs, labels), ["doc_id"]).collect()}
    assert {r["doc_id"] for r in one.collect()} == {d for d, s in score.items() if s >= 0.3}
    two = cut(near(spark, one, sf))
    parts = brute_components([(r["doc_id"], r["text"]) for r in one.collect()], 5, 80, 100)
    assert sorted(r["doc_id"] for r in two.collect()) == sorted({c for _, _, c in parts})
    three = cut(repeats(spark, two, sf))
    left = collections.Counter((r["doc_id"], len((r["text"] or "").encode())) for r in three.collect())
    want = collections.Counter((d, n - gone) for d, n, gone, _, _ in brute_repeats([(r["doc_id"], r["text"]) for r in two.collect()]))
    assert sum((left - want).values()) <= 5 and all(r["n_chars"] == len(r["text"]) for r in three.collect())  # a cut inside a character takes it whole
    four = cut(mix(spark, three, sf))
    plan = {r["doc_id"]: r["copies"] for r in mixing.copies(three.select("doc_id", "text", "source")).collect()}
    assert abs(four.count() - sum(plan.values())) <= 40 and four.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    five = tokens(spark, four, sf)
    assert five.count() == four.count() and five.filter("not round_trip").count() == 0
    assert all(x.columns == docs.columns for x in (one, two, three, four))


def test_awkward_rows(spark, sf):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, sf))
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert words(3, 1)


def test_empty_table(spark, sf, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

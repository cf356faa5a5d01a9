"""Texts without id, and of one id, in removal of repeated passages."""

import collections

from pyspark.sql import functions as F

from quillspark.llm import suffix_dedup
from tests.llm.test_operators import brute_repeats, words


def test_texts_without_id_are_spread(spark, monkeypatch):
    """Half of all texts have no id: results by the rule, 2**63 - 1 comes before them, and they are not dealt to one bucket."""
    monkeypatch.setattr(suffix_dedup, "RUN", 20_000)
    monkeypatch.setattr(suffix_dedup, "SORTED", 20_000)
    monkeypatch.setattr(suffix_dedup, "RANGE", 20_000)
    passage = words(60, 1)
    rows = [(i, words(30, i + 10) + (" " + passage if i % 3 == 0 else "")) for i in range(60)]
    rows += [(None, words(40, 500 + i) + " " + passage + " " + words(5, i)) for i in range(60)] + [(None, "same " * 40 + passage)] * 30
    rows += [((1 << 63) - 1, words(50, 900)), (None, words(50, 900)), (7, passage), (7, passage + " " + words(20, 3)), (7, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = suffix_dedup.cleaned(df, ["doc_id"]).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert collections.Counter(tuple(r) for r in out.collect()) == brute_repeats(rows)
    buckets = []

    def cut(df, f=suffix_dedup.cut):
        out = f(df)
        if "bucket" in out.columns:
            buckets.extend(r["n"] for r in out.groupBy("bucket").agg(F.count("*").alias("n")).collect())
        return out

    monkeypatch.setattr(suffix_dedup, "cut", cut)
    suffix_dedup.cleaned(df, ["doc_id"]).count()
    assert len(buckets) > 2 and max(buckets) < sum(buckets) / 2

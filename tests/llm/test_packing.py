"""Packing by powers of two against the tokenizer's own ids."""

import collections
import functools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import packing
from quillspark.llm.token_files import tokenizer_path
from tests.llm.test_operators import SCHEMA, awkward

TOKENIZER = tokenizer_path("byte_bpe_50k.json")


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def library_ids(text):
    return [*library().encode(text or "", add_special_tokens=False).ids, 1]


def test_pieces():
    counts = np.array([1, 2, 3, 2048, 2049, 5000, 4095, 7])
    owner, start, length = packing.pieces(counts)
    for i, n in enumerate(counts.tolist()):
        own = [(s, x) for o, s, x in zip(owner.tolist(), start.tolist(), length.tolist(), strict=True) if o == i]
        assert [s for s, _ in own] == list(np.cumsum([0, *(x for _, x in own)])[:-1]) and sum(x for _, x in own) == n
        assert [x for _, x in own] == [2048] * (n // 2048) + [1 << b for b in range(10, -1, -1) if n % 2048 >> b & 1]
    assert len(packing.pieces(np.array([], "int64"))[0]) == 0
    with pytest.raises(ValueError, match="power of two"):
        packing.powers(1000)


def test_query(spark, sf):
    out = packing.query(spark, sf)
    kinds = dict(out.dtypes)
    assert {k: kinds[k] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")} == dict.fromkeys(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), "bigint")
    rows = out.collect()
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(by_doc) == set(docs)
    for d, text in docs.items():
        ids, at = library_ids(text), 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4")
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += r["length"]
        assert at == len(ids)
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows))) and all(r["offset"] == 0 and r["length"] in packing.powers(2048) for r in rows)
    in_order = [r["length"] for r in sorted(rows, key=lambda r: r["sequence_id"])]
    assert in_order == sorted(in_order, reverse=True)


def test_awkward_rows(spark, tmp_path):
    odd = [*awkward(), (None, "no id", None, None, None, None, None, None), (3, "a b c " * 60_000, "en", "s", 1, 1, 1.0, 1)]
    df = spark.createDataFrame(odd, SCHEMA).withColumn("part", F.lit("x")).withColumn("ids", F.create_map(F.lit(1), F.lit(2)))
    path = str(tmp_path / "packed")
    packing.write_packed(df, TOKENIZER, path, 256)
    rows = packing.numbered(packing.read_packed(spark, path), 256).collect()
    docs = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["row"], r["start"])):
        assert len(r["ids"]) == r["length"] <= 256
        docs[r["row"], r["doc_id"]] += r["ids"]
    assert sorted((str(d), tuple(ids)) for (_, d), ids in docs.items()) == sorted((str(r[0]), tuple(library_ids(r[1]))) for r in odd)
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    packing.write_packed(df.limit(0), TOKENIZER, str(tmp_path / "none"))
    assert packing.numbered(packing.digests(packing.read_packed(spark, str(tmp_path / "none")))).count() == 0


def test_a_bucket_reads_its_own_pages(spark, sf, tmp_path):
    """A reader of one length takes few rows out of the files, told by what the scan gives on."""
    path = str(tmp_path / "packed")
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(10)))).drop("n")
    packing.write_packed(docs.coalesce(1), TOKENIZER, path)
    every = packing.read_packed(spark, path).count()
    some = packing.read_packed(spark, path, 2048)
    assert "EqualTo(length,2048)" in some._jdf.queryExecution().executedPlan().toString()
    want = packing.read_packed(spark, path).filter(F.col("length") + 0 == 2048).count()
    assert some.count() == want
    some.select("length", "ids").collect()
    plan = some.select("length", "ids")
    plan.write.format("noop").mode("overwrite").save()
    read = _scanned(plan)
    assert want <= read < every / 2


def _scanned(df):
    """Rows that the file scan of a run of df gave on."""
    execution = df._jdf.queryExecution()
    execution.executedPlan().executeCollect()
    leaves = execution.executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))

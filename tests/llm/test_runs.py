"""Periodic runs against a search of all periods."""

import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import runs
from tests.llm.test_operators import SCHEMA, awkward


def brute(s, least=6, exponent=4):
    """(start, length, smallest period) of every maximal stretch, period by period."""
    found = {}
    for p in range(1, len(s) // exponent + 1):
        i = 0
        while i + p < len(s):
            if s[i] != s[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            if j + p - i >= max(least, exponent * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((a, n, p) for (a, n), p in found.items())


def contract(doc_id, text):
    """The row that the query's contract asks for."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n > 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = brute(w)
    dropped = {i for a, size, p in found for i in range(a + p, a + size)}
    start, length, period = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    told = sha("".join(f"{a},{size},{p}\n" for a, size, p in found))
    return (doc_id, len(found), start, length, period, 1000 * length // period if found else None, told, sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(0, 9), st.lists(st.integers(0, 2), max_size=40))
def test_maximal_runs(before, unit, times, after):
    s = before + unit * times + after
    for least, exponent in ((6, 4), (2, 2), (1, 3), (9, 2)):
        want = brute(s, least, exponent)
        assert runs.maximal_runs(s, least, exponent) == want
        assert runs.runs_of([b"%d" % c for c in s], least, exponent) == want


def test_runs_inside_copied_factors():
    """A passage that holds runs recurs thrice, so that these runs come from copies, among them one that begins the copy."""
    r = random.Random(3)
    word = lambda n: [r.randrange(1000) for _ in range(n)]
    passage = [7] * 6 + word(30) + [1, 2] * 5 + word(20) + [3, 4, 5] * 4 + word(9) + [6] * 8
    s = word(50) + passage + word(13) + passage + passage + word(5) + passage * 5
    assert runs.maximal_runs(s) == brute(s) and len(runs.maximal_runs(s)) > 20


def test_factors_are_the_longest_that_begin_earlier():
    r = random.Random(5)
    for _ in range(300):
        s = [r.randrange(3) for _ in range(r.randrange(0, 40))]
        parts = runs.factors(s)
        ends = [a for a, _ in parts[1:]] + [len(s)]
        for (a, source), e in zip(parts, ends, strict=False):
            longest = max((k for i in range(a) for k in range(len(s) - a + 1) if s[i : i + k] == s[a : a + k]), default=0)
            assert e - a == max(1, longest) and (source < 0) == (longest == 0)
            assert source < 0 or (source < a and s[source : source + e - a] == s[a:e])


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = sorted(tuple(r) for r in runs.query(spark, sf).select(*COLUMNS).collect())
    want = sorted(contract(r["doc_id"], r["text"]) for r in docs)
    assert got == want and sum(r[1] for r in got) > 0
    assert dict(runs.query(spark, sf).dtypes) == dict.fromkeys(COLUMNS[:6], "bigint") | dict.fromkeys(COLUMNS[6:], "string")


def test_awkward_rows(spark, tmp_path):
    far = " ".join(["a b c d"] * 50_000)
    odd = [*awkward(), (None, "x " * 9, None, None, None, None, None, None), (77, "x y x y\tx y x y x y\x0bx y", "en", "s", 1, 1, 1.0, 1), (78, far, "en", "s", 1, 1, 1.0, 1)]
    df = spark.createDataFrame(odd, SCHEMA)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = runs.query(spark, str(tmp_path)).select(*COLUMNS).collect()
    assert len(got) == len(odd)
    few = {r[0] for r in odd} - {78}
    assert sorted((tuple(map(str, r)) for r in got if r["doc_id"] in few)) == sorted(tuple(map(str, contract(r[0], r[1]))) for r in odd if r[0] in few)
    clash = df.withColumnRenamed("rank", "runs").withColumn("m", F.create_map(F.lit("k"), F.struct(F.lit(1).alias("a b"))))
    out = runs.periodic(clash)
    assert out.columns == [*clash.columns, "runs_", "collapsed"]
    long = out.filter("doc_id = 78").first()
    assert [tuple(r) for r in long["runs_"]] == [(0, 200_000, 4)] and long["collapsed"] == "a b c d" and long["m"]["k"][0] == 1
    assert all(r["runs_"] == [] and r["collapsed"] == "" for r in out.filter("text is null or text = ''").collect())
    assert runs.periodic(clash.limit(0)).count() == 0

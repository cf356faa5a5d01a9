"""What the lists of the n-gram join keep: entries that may have a partner, and nothing of what was compared."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import shingle_join
from tests.llm.test_operators import brute_components


def texts(seed, n, vocabulary=60):
    """Unlike texts of many lengths that share n-grams, and chains of near copies of some of them."""
    r = random.Random(seed)
    rows = [[f"w{r.randrange(vocabulary)}" for _ in range(r.randint(12, 160))] for _ in range(n)]
    for i in range(0, n, 7):
        t = rows[i]
        for _ in range(r.randint(1, 6)):
            t = list(t)
            t[r.randrange(len(t))] = f"new{r.randrange(10**6)}"
            rows.append(t)
    return [(i, " ".join(t)) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("short", "num", "width"), [(256, 90, 2), (3, 90, 2), (4, 80, 2), (0, 80, 3), (256, 60, 2)])
def test_lists_of_unlike_texts(spark, monkeypatch, short, num, width):
    """Lists are judged whole, in part or not at all; the components are the same."""
    monkeypatch.setattr(shingle_join, "SHORT", short)
    rows = texts(num + width, 160)
    got = collections.Counter(tuple(x) for x in shingle_join.link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width, num, 100).collect())
    assert got == brute_components(rows, width, num, 100)


def test_slices_are_judged_by_their_own_place(spark):
    """Sets of several slices, and partners that have fewer, over and under the threshold."""
    r = random.Random(3)
    rows = []
    for size in (1000, 1060, 4090, 4200):
        base = [f"{size}x{i}" for i in range(size)]
        for k in (0.0, 0.02, 0.05, 0.06, 0.12):
            rows.append([f"n{r.random()}" if r.random() < k else w for w in base])
        rows.append(base[: int(size * 0.91)])
        rows.append(base[: int(size * 0.89)] + ["end"])
    rows = [(i, " ".join(t)) for i, t in enumerate(rows)]
    got = collections.Counter(tuple(x) for x in shingle_join.link_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, 90, 100).collect())
    assert got == brute_components(rows, 1, 90, 100)


def test_entries_without_a_partner_get_no_bitmap(spark, monkeypatch):
    """Texts that share n-grams but are unlike in size or in the place of what they share leave the lists before bitmaps are dealt."""
    seen = []

    def compare(members, t, heads, f=shingle_join._compare):
        rows = members.select("key", "node", F.length("bits").alias("bytes")).collect()
        seen.append((heads, len(rows), {r["bytes"] for r in rows}))
        return f(members, t, heads)

    monkeypatch.setattr(shingle_join, "_compare", compare)
    rows = texts(1, 200)
    posts = collections.Counter(key for _, x in rows for key in _prefix(x))
    shared = sum(c for c in posts.values() if c > 1)
    shingle_join.link_components(spark.createDataFrame(rows, "doc_id long, text string"), 2, 90, 100).count()
    (_, first, size), (_, rest, _) = seen
    assert first < 0.6 * shared  # all of them before
    assert rest < 0.2 * first  # all lists that held unlike texts before
    assert size == {32}  # 128 before


def _prefix(text):
    s = shingle_join.shingle_sets([text], 2)[0]
    return s[: shingle_join.Threshold(90, 100).prefix(len(s))].tolist()


def test_folded_bitmaps_bound_the_difference():
    r = np.random.default_rng(2)
    for num in (50, 80, 90, 99):
        t = shingle_join.Threshold(num, 100)
        bits = t.width()
        assert bits <= shingle_join.BITS and shingle_join.BITS % bits == 0
        for n in (1, 30, 700, 1023, 5000):
            s = r.integers(0, 1 << 63, n, dtype="uint64")
            other = np.r_[s[: n - n // 20], r.integers(0, 1 << 63, n // 20, dtype="uint64")]
            k = shingle_join.slices(n)
            x, y = (shingle_join._brief(shingle_join.parity(a, k), bits) for a in (s, other))
            assert len(x) == k * bits // 8 and np.bitwise_count(x ^ y).sum() <= 2 * (n // 20)

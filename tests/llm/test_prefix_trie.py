"""The prefix trie against one that is built turn by turn, with fingerprints short enough to collide and hot prefixes."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(convs):
    """The nodes of {conv_id: [(role, text)]}."""
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    rows = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k))
        rows.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def contract(rows):
    """The rebuilt conversations of (conv_id, turn, role, text)."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x)] for c, x in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[: h[c]] + x[h[c] :] for c, x in own.items()}


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def made(seed, n=150):
    r = random.Random(seed)
    say = lambda: (r.choice(["user", "assistant", ""]), r.choice(["", "a", "b", "é 😀"]))
    stock = [say() for _ in range(6)]
    return {c: stock[: r.randrange(7)] + [say() for _ in range(r.randrange(4))] for c in r.sample(range(1000), n)}


def frames(spark, convs):
    turns = spark.createDataFrame([(c, i, *t) for c, x in convs.items() for i, t in enumerate(x)], "conv_id long, place long, role string, text string")
    return turns, spark.createDataFrame([(c,) for c in convs], "conv_id long")


@pytest.mark.parametrize("bits", [64, 9])
def test_trie(spark, bits, monkeypatch):
    """With 9 bits many candidates mix contents at first and are split."""
    monkeypatch.setattr(prefix_trie, "SLICE", 2)
    rounds = []
    monkeypatch.setattr(prefix_trie, "scanned", lambda *a, f=prefix_trie.scanned: rounds.append(a) or f(*a))
    convs = made(bits, 150 if bits == 64 else 400)
    found = prefix_trie.trie(*frames(spark, convs), bits=bits)
    rows = found.nodes.join(prefix_trie.ends_digests(found.ends), ["depth", "fingerprint"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    assert got(rows) == sorted(brute(convs), key=str)
    assert len(rounds) > 2 if bits == 9 else len(rounds) == 2


def test_query(spark, sf):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    out = prefix_trie.query(spark, sf)
    assert got(out) == sorted(brute(contract(rows)), key=str)
    assert dict(out.dtypes) == dict.fromkeys(COLUMNS[:-1], "bigint") | {"ends_sha256": "string"}


def test_awkward_rows(spark, tmp_path):
    """Nulls, repeated rows, long texts, a conversation with most of all rows, one that its family leaves without turns, clashing names."""
    r = random.Random(9)
    rows = [(c, t, r.choice(["user", None]), r.choice([None, "", "x", "y z"])) for c in range(95, 320, 3) for t in range(r.randrange(1, 9))]
    rows += [(c, None, "user", "late") for c in range(200, 204)] + [(201, 3, "user", "x")] * 5 + [(None, 1, "user", "lost")] * 4
    rows += [(700 + c % 7, t, "system", "same") for c in range(7) for t in range(4)] + [(900, t, "user", "w " * (t % 3)) for t in range(130)]
    rows += [(905, 0, "user", "short"), (902, 0, "a", "long " * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit(1)).withColumn("_n", F.lit("x")).withColumn("place", F.create_map(F.lit(1), F.lit(2)))
    df.repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    assert got(prefix_trie.query(spark, str(tmp_path))) == sorted(brute(contract(rows)), key=str)


def test_sums_across_tasks(spark):
    """One key over all tasks: numbers and polynomial sums go on from one task to the next."""
    rows = [(5, i, 3 * i + 1) for i in range(2000)] + [(4, 0, 9), (6, 0, 8), (6, 1, 7)]
    out = prefix_trie.scanned(spark.createDataFrame(rows, "k long, i long, v long"), "k", [F.col("i")], "v", prefix_trie.BASE)
    total, n, last = 0, 0, None
    for k, _, v, place, s, before in sorted(tuple(r) for r in out.collect()):
        total, n = (total, n) if k == last else (0, 0)
        assert before % 2**64 == total
        n, last = n + 1, k
        total = (total + v * pow(prefix_trie.BASE, n, 2**64)) % 2**64
        assert (place, s % 2**64) == (n, total)


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert prefix_trie.query(spark, str(tmp_path)).count() == 0
    spark.createDataFrame([(None, 1, "user", "x")], SCHEMA).write.mode("overwrite").parquet(str(tmp_path / "conversations.parquet"))
    assert prefix_trie.query(spark, str(tmp_path)).count() == 0

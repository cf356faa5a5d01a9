"""Each operator against a brute-force version, on real small tables and on rows made to be awkward."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import components, hilbert, loser_tree, mixing, nbest_pieces, rule_ensemble, shingle_join, suffix_dedup, token_files, topk, warc_audit, weak_rules
from quillspark.llm.registry import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, rank int"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(2, 7))) for _ in range(n))


def awkward():
    """Nulls, empties, blanks, ties, repeated rows, copies, near copies, a long text, odd characters; columns with clashing names."""
    base = words(150, 1)
    passage = words(25, 2)
    texts = [None, "", " \n\t", "one", "one two", "A B c", base, base, base.replace(" ", " x ", 1), words(90, 3) + " " + passage + " " + words(30, 4), words(40, 5) + " " + passage, "ha " * 400, words(20000, 6), "猫 und ▁ é\x0bz\n" * 9, words(150, 1).upper(), "a" * 3000, "$$ ## " * 60, "line with words\n" * 30]
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 5 else None, None if t is None else len(t), 5, 0.5, 1) for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[6], (None, "no id " + words(30, 8), "en", "src1", 3, 5, 0.5, 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def brute_components(rows, width, num, den):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return collections.Counter((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80), (1, 50)])
def test_shingle_join(odd, docs, width, num):
    for df in (odd, docs):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        got = collections.Counter(tuple(r) for r in shingle_join.link_components(df, width, num, 100).collect())
        assert got == brute_components(rows, width, num, 100)


def test_shingle_join_light_sets(spark):
    """Many small sets, so that the boundary puts some on the subset side."""
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(300):
        t = [r.choice(vocabulary) for _ in range(r.randint(3, 26))] if i % 3 == 0 or not rows else list(rows[-1][1].split())
        if i % 3:
            t[r.randrange(len(t))] = r.choice(vocabulary)
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for num in (80, 90):
        got = collections.Counter(tuple(x) for x in shingle_join.link_components(df, 1, num, 100).collect())
        assert got == brute_components(rows, 1, num, 100)
    t = shingle_join.Threshold(90, 100)
    assert shingle_join.boundary({5: 10, 10: 100, 20: 100}, t, 50.0) >= 10 and t.sizes(10) == [9, 10] and t.overlap(20, 18) == 18


def test_long_lists_are_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "BLOCK", 4)
    base = words(60, 9).split()
    rows = [(i, " ".join([*base[:i], f"new{i}", *base[i + 1 :]])) for i in range(0, 60, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter(tuple(x) for x in shingle_join.link_components(df, 2, 85, 100).collect())
    assert got == brute_components(rows, 2, 85, 100)


def test_one_row_of_each_component_stays(spark):
    """Ids that unlike texts share, and rows without id that are near copies of one another or of a row with one."""
    a, b, c, d = (words(60, s) for s in range(40, 44))
    rows = [(1, a), (1, b), (2, a + " x"), (None, c), (None, c + " x"), (None, d), (3, d + " x"), (4, None), (4, None), (None, ""), (1, b)]
    got = shingle_join.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = collections.Counter([(1, a), (1, b), (3, d + " x"), (4, None), (4, None), (None, "")])
    found = collections.Counter(tuple(r) for r in got)
    assert found - want in (collections.Counter([(None, c)]), collections.Counter([(None, c + " x")])) and not want - found


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (102, 101), (5, 5)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 21)) and got[102] == 100 and 5 in got


def brute_repeats(rows):
    """(doc_id, bytes, removed, spans, digest) where strings of smaller ids go; rows of one id do not touch each other."""
    big = 1 << 63
    raw = [((d if d is not None else big), d, (t or "").encode()) for d, t in rows]
    first = {}
    for key, _, b in raw:
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            first[w] = min(first.get(w, key), key)
    out = collections.Counter()
    for key, d, b in raw:
        gone = np.zeros(len(b) + 2, "int8")
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < key:
                gone[i + 1 : i + 51] = 1
        mask = gone[1:-1].astype(bool)
        spans = int((np.diff(gone) == 1).sum())
        out[d, len(b), int(mask.sum()), spans, hashlib.sha256(np.frombuffer(b, "uint8")[~mask].tobytes()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("small", [True, False])
def test_suffix_dedup(odd, docs, small, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "RUN", 20_000)
    monkeypatch.setattr(suffix_dedup, "SORTED", 20_000)
    monkeypatch.setattr(suffix_dedup, "RANGE", 50_000)
    if not small:
        monkeypatch.setattr(suffix_dedup, "SMALL", 0)
        monkeypatch.setattr(suffix_dedup, "SMALL_BYTES", 0)
    for df in (odd, docs):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        out = suffix_dedup.cleaned(df, ["doc_id"]).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
        assert collections.Counter(tuple(r) for r in out.collect()) == brute_repeats(rows)


def test_anchors_do_not_depend_on_slices(monkeypatch):
    data = np.frombuffer((words(3000, 5) + "z" * 500).encode(), "uint8")
    one = suffix_dedup.anchors(data, np.array([4000, 4000, len(data)]))
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(one[2], one[3], strict=True)])
    assert sorted(covered) == [*range(3951), *range(4000, len(data) - 49)]
    monkeypatch.setattr(suffix_dedup, "SLICE", 1000)
    two = suffix_dedup.anchors(data, np.array([4000, 4000, len(data)]))
    spread = lambda x: sorted((s, p) for p, a, b in zip(x[0], x[2], x[3], strict=True) for s in range(a, b + 1))
    assert spread(one) == spread(two)


def test_loser_tree():
    r = random.Random(3)
    for _ in range(200):
        runs = [sorted(bytes(r.choice(b"ab") for _ in range(r.randint(0, 9))) for _ in range(r.randint(0, 12))) for _ in range(r.randint(0, 9))]
        coded = [loser_tree.front_coded(s, [0, *[loser_tree.common(a, b) for a, b in itertools.pairwise(s)]][: len(s)]) for s in runs]
        out = list(loser_tree.merge([loser_tree.decoded(c) for c in coded]))
        assert [(s, i) for i, s, _ in out] == sorted((s, i) for i, run in enumerate(runs) for s in run)
        assert all(n == loser_tree.common(a[1], b[1]) for a, b in itertools.pairwise(out) for n in [b[2]])


def test_hilbert(odd, docs, empty):
    for bits, d in ((2, 2), (2, 3), (3, 2)):
        cells = np.array(list(itertools.product(range(2**bits), repeat=d)))
        order = cells[np.argsort(hilbert.curve_index(cells, bits))]
        assert sorted(hilbert.curve_index(cells, bits)) == list(range(len(cells))) and (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()
    for df in (odd, docs):
        rows = hilbert.hilbert_shards(df, ["source", "lang", "n_chars"], 7, [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars")], ["doc_id"]).collect()
        by = collections.defaultdict(list)
        for r in rows:
            by[r["shard"]].append(r["slot"])
        n = [len(by[s]) for s in range(7)]
        assert len(rows) == df.count() and max(n) - min(n) <= 1 and all(sorted(x) == list(range(len(x))) for x in by.values())
    assert hilbert.hilbert_shards(empty, ["source"], 7, [F.col("doc_id"), F.col("source")], ["doc_id"]).count() == 0


def test_hilbert_files_prune(docs, tmp_path, spark):
    """Files hold all rows, and a filter on either dimension leaves most shards out by their least and greatest values."""
    hilbert.write_shards(docs, ["source", "n_chars"], 16, str(tmp_path / "s"))
    rows = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(r["doc_id"] for r in rows.collect()) == sorted(r["doc_id"] for r in docs.collect())
    zones = hilbert.zone_map(rows, ["source", "n_chars"]).collect()
    assert sum(r["n_rows"] for r in zones) == docs.count() and len(zones) == 16
    values = [(r["source"], r["n_chars"]) for r in docs.select("source", "n_chars").collect()]
    for c, k in (("source", 0), ("n_chars", 1)):
        met = [sum(z[f"min_{c}"] <= v[k] <= z[f"max_{c}"] for z in zones) for v in values]
        assert sum(met) / len(met) < 8


def test_shards_hold_each_row_once(spark, odd, tmp_path):
    """Null and repeated ids, maps, and columns named as the shards' own."""
    rows = spark.createDataFrame([(1, "a", 7, {"k": 1}), (1, "a", 8, None), (None, "b", None, {}), (None, None, 9, {"k": 2})], "doc_id long, source string, shard int, slot map<string,int>")
    hilbert.write_shards(rows, ["source"], 3, str(tmp_path / "s"))
    got = spark.read.parquet(str(tmp_path / "s"))
    assert collections.Counter(map(str, got.select(*rows.columns).collect())) == collections.Counter(map(str, rows.collect())) and set(got.columns) == {*rows.columns, "shard_", "slot_"}
    hilbert.write_shards(odd, ["source", "lang", "n_chars"], 5, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == odd.count()


def test_strings_are_cut_by_all_their_bytes(spark):
    long = "x" * 500
    df = spark.createDataFrame([(f"{long}{i:03}",) for i in range(200)] + [(None,)], "source string")
    got = hilbert.with_curve_index(df, ["source"], [F.col("source")], 4).collect()
    codes = {r["source"]: r["curve_index"] for r in got}
    assert codes[None] == 0 and len(set(codes.values())) == 16
    order = [codes[k] for k in sorted(k for k in codes if k)]
    assert order == sorted(order)


def test_rule_ensemble_fit():
    r = np.random.default_rng(1)
    x = r.random((3000, 4))
    y = ((x[:, 0] > 0.6) & (x[:, 1] < 0.5) | (x[:, 2] > 0.9)).astype(float)
    b, rules = rule_ensemble.fit(x, y)
    score = b + sum(w * rule_ensemble.holds(p, x) for p, w in rules)
    assert ((score > 0) == (y > 0)).mean() > 0.97
    assert rule_ensemble.fit(x[:3], y[:3]) == (0.0, []) and rule_ensemble.fit(x, y * 0) == (0.0, [])


def test_rule_ensemble(spark, odd, empty, docs):
    d, l = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")  # noqa: E741
    model = rule_ensemble.train(d, l)
    got = rule_ensemble.scored(d, model, ["doc_id"]).join(l, "doc_id").toPandas()
    held = got[[zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]]
    good, bad = held[held.quality == 1].score.values, held[held.quality == 0].score.values
    assert (good[:, None] > bad).mean() > 0.95 and (good >= 0.3).mean() > 0.97
    rows = rule_ensemble.scored(odd, model, ["doc_id"]).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert rule_ensemble.scored(empty, model, ["doc_id"]).count() == 0
    one = odd.select("doc_id", rule_ensemble.score(F.col("text"), model).alias("score"))
    assert sorted(map(str, one.collect())) == sorted(map(str, rows))
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0), (999, 1)], "doc_id long, quality int")
    kept = rule_ensemble.accepted(odd, labels)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def base_counts(t):
    w = WORD.findall(t or "")
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(inside)


def test_weak_rules(odd, docs, empty):
    for df in (odd, docs):
        stats = weak_rules.judged(weak_rules.statistics(df))
        got = collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in stats.collect())
        assert got == collections.Counter((d, *base_counts(t)) for d, t in map(tuple, df.select("doc_id", "text").collect()))
        for r in stats.collect():
            assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["kept"] and r["base_failed"])
    assert weak_rules.judged(weak_rules.statistics(empty)).count() == 0


def test_em_finds_accuracies():
    r = random.Random(2)
    truth = [r.random() < 0.5 for _ in range(20000)]
    rate = [0.95, 0.8, 0.65]
    votes = collections.Counter(tuple((1 if (y == (r.random() < a)) else -1) if r.random() < 0.8 else 0 for a in rate) for y in truth)
    got = weak_rules.estimate(sorted(votes.items()))
    assert all(abs(g - a) < 0.08 for g, a in zip(got, rate, strict=True)) and got == sorted(got, reverse=True)


def test_nbest_against_brute_force():
    model = nbest_pieces.pieces(nbest_pieces.model_path())

    def brute(s):
        out = []

        def go(i, score, ids):
            if i == len(s):
                out.append((score, tuple(ids)))
            for e in range(i + 1, min(len(s), i + model.longest) + 1):
                if s[i:e] in model.known:
                    go(e, score + model.known[s[i:e]][1], [*ids, model.known[s[i:e]][0]])
            if i < len(s) and s[i] not in model.known:
                go(i + 1, score + model.unknown, [*ids, *[model.bytes[b] for b in s[i].encode()]])

        go(0, 0.0, [])
        return sorted(out, key=lambda x: -x[0])

    r = random.Random(1)
    for _ in range(150):
        t = "".join(r.choice("theanion ,.é\n猫") for _ in range(r.randint(1, 9)))
        every = brute("▁" + t.replace(" ", "▁"))
        best, score, others = model.encode(t, 4)
        got = [(score - g, tuple(np.frombuffer(i, "<i4").tolist())) for g, i in [(0.0, best), *others]]
        assert [s for s, _ in got] == [s for s, _ in every[:4]] and len({i for _, i in got}) == len(got) and set(got) <= set(every)
        assert model.decode(list(got[0][1])) == t


def test_nbest_rows(odd, empty):
    rows = nbest_pieces.segmented(odd, nbest_pieces.model_path(), ids=True).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<i4").tobytes())
        assert r["round_trip"] == ("▁" not in (dict((x[0], x[1]) for x in awkward()).get(r["doc_id"]) or ""))
        scores = [s["score"] for s in r["segmentations"]]
        assert scores == sorted(scores, reverse=True) and scores[0] == r["score"]
    assert nbest_pieces.segmented(empty, nbest_pieces.model_path()).count() == 0


def test_nbest_after_a_smaller_n():
    model, fresh = (nbest_pieces.Pieces(nbest_pieces.model_path()) for _ in range(2))
    text = "some words of a text"
    assert model.encode(text, 1)[2] == [] and len(fresh.encode(text, 4)[2]) == 3
    assert model.encode(text, 4) == fresh.encode(text, 4)


def test_targets():
    t = mixing.targets([("b", 100), ("a", 10), (None, 50), ("c", 0)])
    assert t["a"] == 30 and t["c"] == 0 and abs(sum(t.values()) - 160) < 1e-9 and t["b"] / t[None] == pytest.approx(2 / 5)


def test_mixing(odd, docs, empty):
    for df, near in ((docs, 0.02), (odd, None)):
        rows = mixing.copies(df.select("doc_id", "text", "source")).collect()
        by = collections.defaultdict(lambda: [0, 0.0, 0])
        for r in rows:
            x = by[r["source"]]
            x[0] += r["copies"] * r["size"]
            x[1], x[2] = r["target"], r["source_size"]
            assert 0 <= r["copies"] <= 3
        for s, (taken, target, size) in by.items():
            largest = max(r["size"] for r in rows if r["source"] == s)
            assert abs(taken - target) <= (max(near * target, 40) if near else largest) and target <= 3 * size + 1e-6
    again = lambda: sorted((str(r["doc_id"]), r["copies"]) for r in mixing.copies(docs.select("doc_id", "text", "source")).collect())
    assert again() == again()
    mix = mixing.mixture(odd)
    assert mix.columns == odd.columns and mixing.mixture(empty).count() == 0
    want = sum(r["copies"] for r in mixing.copies(odd.select("doc_id", "text", "source")).collect())
    assert abs(mix.count() - want) <= 3


def test_token_files(spark, odd, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = token_files.tokenizer_path()
    tok = Tokenizer.from_file(path)
    for k, df in enumerate((docs, odd)):
        out = str(tmp_path / str(k))
        token_files.write_ids(df, path, out)
        got = token_files.digests(token_files.read_ids(spark, out)).orderBy("start").collect()
        hashes = dict(tuple(r) for r in df.select("text", F.xxhash64("text")).collect())
        rows = sorted((tuple(r) for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is None, r[0] or 0, hashes[r[1]], r[1] is not None, r[1] or ""))
        at = 0
        for g, (d, t) in zip(got, rows, strict=True):
            ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
            assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += len(ids)
        assert token_files.read_ids(spark, out, 3, 5).filter("doc_id is not null").count() == 3
    token_files.write_ids(empty, path, str(tmp_path / "e"))
    assert token_files.digests(token_files.read_ids(spark, str(tmp_path / "e"))).count() == 0


TOKENIZER_FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


@pytest.mark.parametrize("name", TOKENIZER_FILES)
def test_token_units_as_the_tokenizer_has_them(name, docs):
    from tokenizers import Tokenizer

    path = token_files.tokenizer_path(name)
    tok, model = Tokenizer.from_file(path), token_files.Encoder(path)
    assert model.apart
    texts = ["it's 'S they'll I'd 12a3 a_b", "Straße ÜBER é\x1fx\xa0y", "x<|endoftext|>y <|endoftext|> z", "''s ...'t'", "é Σας ẞ  \u0301a e\u0301 \u0301", "ab\x0bcd\x0c\r\n", None, "", "  two  \xa0 spaces \u2003x\u3000 y", "a" * 300 + " b", "猫 犬  鳥", " ", "\n\n x"]
    r = random.Random(5)
    texts += ["".join(r.choice(" \n\tab'sé\xa0\u3000猫1.") for _ in range(40)) for _ in range(300)]
    texts += [x["text"] for x in docs.select("text").collect()]
    for _ in range(2):  # with ids remembered, too
        flat, counts = model.encode(texts, 2)
        at = 0
        for t, n in zip(texts, counts, strict=True):
            assert flat[at : at + n].tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, 2], t
            at += n
        assert at == len(flat)


def test_texts_stay_whole_where_steps_may_reach_across_spaces():
    import json

    made = json.load(open(token_files.tokenizer_path()))
    assert token_files.cuts_at_spaces(made)
    for key, value in [("pre_tokenizer", None), ("normalizer", {"type": "Strip", "strip_left": True, "strip_right": True}), ("added_tokens", [{"content": "a b"}]), ("pre_tokenizer", {"type": "Split", "pattern": {"Regex": "[^,]+"}, "behavior": "Removed", "invert": True}), ("pre_tokenizer", {"type": "Split", "pattern": {"Regex": "\\w+ ?"}, "behavior": "Removed", "invert": True}), ("pre_tokenizer", {"type": "Metaspace"})]:
        assert not token_files.cuts_at_spaces(made | {key: value}), value


def test_topk(spark, sf, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "BUCKET", 16)
    monkeypatch.setattr(topk, "CHUNK", 2048)
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    odd = [(1000, None), (1100, [1.0, None]), (1200, [float("nan")] * 64), (1300, []), (1400, [0.0] * 64), (1500, rows[0][1]), (1501, rows[0][1]), (1600, [3.0, -2.5]), (1700, [float(x) * 50 for x in rows[3][1]]), (None, [1.0] * 64)]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>")
    v = topk.quantised(df)
    got = collections.defaultdict(list)
    for r in topk.top_k(v, v.filter("vec_id % 100 = 0"), 10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    whole = {i: [int(np.floor(1024 * x)) for x in e] for i, e in [*rows, *odd] if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    for q in (i for i in whole if i % 100 == 0):
        scores = sorted(((-sum(a * b for a, b in zip(whole[q], w, strict=False)), i) for i, w in whole.items() if i != q))[:10]
        assert got[q] == [(i, -s) for s, i in scores]
    assert topk.top_k(v.limit(0), v.limit(0), 10).count() == 0
    one = v.filter("vec_id = 100")
    assert topk.top_k(one, one, 10).count() == 0


def test_large_products():
    a = np.array([[2.0**40, 3.0]])
    assert topk.products(a, np.array([2.0**20, 5.0]))[0] == 2**60 + 15
    assert topk.products(a, np.array([2.0**40, 5.0]))[0] == 2**63 - 1


def test_warc_files(spark, sf, tmp_path):
    """Records come back from the files with their ranges; a lost, a longer, a shorter and a flipped record are found, and only they."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").unionByName(spark.createDataFrame([(900, None, None), (901, "http://é", ""), (901, "http://é", ""), (None, "u", "x"), (902, "v", "WARC/1.0 \r\n\r\n in a body")], "page_id long, url string, html string"))
    placed = warc_audit.laid_out(warc_audit.hashed(pages), 8192).cache()
    rows = sorted(placed.collect(), key=lambda r: (r["file"], r["seq"]))
    for f, group in itertools.groupby(rows, key=lambda r: r["file"]):
        at = 0
        for k, r in enumerate(group):
            assert (r["seq"], r["offset"]) == (k, at)
            at += r["length"]
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    warc_audit.write_warc(placed, one, [F.col("record"), F.col("record")], [F.col("seq")])
    found = [r for r in warc_audit.index(spark, one).collect() if r["replica"] == 0]
    assert sorted((r["file"], r["seq"], r["offset"], r["length"], r["sha256"]) for r in found) == [(r["file"], r["seq"], r["offset"], r["length"], r["sha256"]) for r in rows]
    raw = b"".join(bytes(r["record"]) for r in rows)
    assert [b.decode() for _, b in warc_audit.parse(raw)] == [p["html"] or "" for r in rows for p in [next(p for p in pages.collect() if p["page_id"] == r["page_id"] and p["url"] == r["url"])]]

    spots = [r for r in rows if r["length"] > 300][::5]
    change = {(r["file"], r["seq"]): ("lost", "longer", "shorter", "flipped")[k % 4] for k, r in enumerate(spots)}
    what = F.create_map(*[F.lit(x) for (f, q), v in change.items() for x in (f"{f}:{q}", v)])[F.concat_ws(":", "file", "seq")]
    n = F.octet_length("record")
    other = F.when(what == "lost", F.lit(None)).when(what == "longer", F.concat("record", F.encode(F.lit("and more\r\n\r\n"), "UTF-8"))).when(what == "shorter", F.concat(F.substring("record", F.lit(1), n - 100), F.encode(F.lit("\r\n\r\n"), "UTF-8"))).when(what == "flipped", F.overlay("record", F.unhex(F.lit("00")), (n - 20).cast("int"), F.lit(1))).otherwise(F.col("record"))
    warc_audit.write_warc(placed, two, [F.col("record"), F.coalesce(other, F.lit(None).cast("binary"))], [F.col("seq")])
    both = warc_audit.index(spark, two)
    for fan in (2, 16):
        levels = warc_audit.tree(both, fan)
        names = {(r["file"], f"{r['id']}#{r['nth']}"): (r["file"], r["seq"]) for r in found}
        got = {names[r["file"], r["node"]]: r["kind"] for r in warc_audit.audit(levels).collect()}
        assert got == {k: "lost" if v == "lost" else "damaged" for k, v in change.items()}
    same = warc_audit.index(spark, one)
    assert warc_audit.audit(warc_audit.tree(same)).count() == 0
    assert warc_audit.laid_out(warc_audit.hashed(pages.limit(0))).count() == 0 and warc_audit.audit(warc_audit.tree(both.limit(0))).count() == 0


def test_files_by_their_first_rows(spark, sf):
    """The ranges give each row the file that the layout gives it, with rows that are the same over several files."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    same = pages.limit(1).withColumn("page_id", F.lit(None).cast("long")).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(40)))).drop("n")
    rows = warc_audit.hashed(pages.unionByName(same)).cache()
    places = warc_audit.laid_out(rows.drop("record", "url"), 4096).cache()
    want = {r["row"]: r["file"] for r in places.collect()}
    assert {r["row"]: r["file"] for r in warc_audit.in_files(rows, places).collect()} == want and len(set(want.values())) > 5


def test_warc_query_over_no_pages(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/pages.parquet").limit(0).write.parquet(str(tmp_path / "pages.parquet"))
    assert warc_audit.query(spark, str(tmp_path)).count() == 0


def test_empty_tables(empty):
    assert shingle_join.link_components(empty).count() == 0
    assert suffix_dedup.cleaned(empty, ["doc_id"]).count() == 0
    assert mixing.copies(empty.select("doc_id", "text", "source")).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("pages", "embeddings"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf).toPandas(), c.sql(ORACLES[name]).df()
    order = sorted(want.columns)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[order].itertuples(index=False))
    assert sorted(got.columns) == order and rows(got) == rows(want)


CLASHING = ["kept", "spans", "n_bytes", "n_removed", "n_spans", "_id", "_tag", "row", "_copies", "copies", "_copy", "key1", "_row", "size", "rank", "_part", "bucket", "target"]


def test_columns_of_any_name(spark):
    """Each stage's operator over rows whose other columns bear the names that operators use, and a map."""
    passage = words(40, 71)
    texts = [words(30, 72) + " " + passage, words(30, 73) + " " + passage, None, words(30, 72) + " " + passage, ""]
    rows = [(i, t, f"s{i % 2}", *range(len(CLASHING)), {"a": i}) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in CLASHING) + ", extra map<string,int>")
    for operator in (suffix_dedup.without_repeats, mixing.mixture, shingle_join.distinct_documents):
        out = operator(df)
        got = out.collect()
        assert out.columns == df.columns and got and all(r["kept"] == 0 and r["bucket"] == CLASHING.index("bucket") and r["extra"] == {"a": r["doc_id"]} for r in got)
    assert {r["doc_id"] for r in shingle_join.distinct_documents(df).collect()} == {0, 1, 2, 4}


def test_rates_solve_the_dual(docs):
    """Rates are exp(lam * size / mean) under the cap, and a source's words at these rates are its target."""
    rows = mixing.copies(docs.select("doc_id", "text", "source")).collect()
    for _, group in itertools.groupby(sorted(rows, key=lambda r: r["source"]), key=lambda r: r["source"]):
        group = list(group)
        assert sum(r["rate"] * r["size"] for r in group) == pytest.approx(group[0]["target"], rel=1e-6)
        free = [(r["size"], np.log(r["rate"])) for r in group if 0 < r["size"] and 0 < r["rate"] < 3 - 1e-9]
        slopes = [y / x for x, y in free]
        assert not slopes or max(slopes) - min(slopes) < 1e-9 * max(1, abs(max(slopes)))


CONTRACTS = {
    "op1_hilbert_shards": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op2_rule_ensemble": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op4_nbest_pieces": {"doc_id": "bigint", "n_tokens": "bigint", "score": "double", "round_trip": "boolean"},
    "op5_entropy_mix": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op6_shingle_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op7_weak_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op9_token_parquet": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op10_norm_topk": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_queries_return_what_their_contract_says(spark, sf, name):
    out = QUERIES[name](spark, sf)
    kinds = dict(out.dtypes)
    assert {c: kinds[c] for c in CONTRACTS[name]} == CONTRACTS[name]
    rows = out.collect()
    if name != "op10_norm_topk":
        assert sorted(r["doc_id"] for r in rows) == list(range(len(rows)))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    if name == "op1_hilbert_shards":
        assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["law"] == "rows" and r["grown_shard"] is None for r in rows)
        assert {r["shard"] for r in rows} == set(range(40))
    if name == "op2_rule_ensemble":
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    if name == "op4_nbest_pieces":
        assert all(r["round_trip"] for r in rows)


def test_compiled_rules_are_the_rules(spark):
    r = np.random.default_rng(5)
    x = r.random((400, 3))
    rules = [((((0, "<=", 0.5),)), 1.25), (((1, ">", 0.3), (2, "<=", 0.7)), -2.0), (((0, ">", 0.2), (1, "<=", 0.9), (2, ">", 0.1)), 0.5)]
    want = 1 / (1 + np.exp(-(0.25 + sum(w * rule_ensemble.holds(p, x) for p, w in rules))))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "i int, values array<double>")
    got = df.select("i", rule_ensemble.compiled(0.25, rules, ["a", "b", "c"], F.col("values")).alias("s")).orderBy("i").collect()
    assert np.allclose([g["s"] for g in got], want)

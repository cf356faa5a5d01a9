"""Features, votes and posteriors of the quality operators, recomputed document by document."""

import collections
import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillspark.llm import rule_ensemble, weak_rules
from tests.llm.test_operators import WORD, docs, odd  # noqa: F401


def upper(t):
    return sum(unicodedata.category(c) == "Lu" for c in t)


def own_features(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n, chars, n_lines = len(w), sum(map(len, w)), t.count("\n") + 1
    over = lambda a, b: a / b if b else 0.0
    echoes = sum(w[i] in w[i + 1 : i + 3] for i in range(n))
    return {
        "n_words": n,
        "word_length": over(chars, n),
        "distinct": over(len(set(w)), n),
        "symbols": over(sum(c in "#*$%&|<>" for c in t), n),
        "marks": over(sum(c in "!?" for c in t), n),
        "upper": over(upper(t), chars),
        "digits": over(sum(c in "0123456789" for c in t), chars),
        "stops": over(sum(c in ".,;:" for c in t), n),
        "dup_lines": over(len(lines) - len(set(lines)), n_lines),
        "line_words": over(n, n_lines),
        "echoes": over(echoes, n),
    }


def test_features(docs, odd):
    """Every feature of every document; and the compiled score is the rules' sum over them."""
    for df in (docs, odd):
        rows = rule_ensemble.statistics(df.select("doc_id", "text").withColumn("own", F.col("text")), ["doc_id", "own"])
        names = list(rule_ensemble.features(F.col("_stat")))
        for r in rows.select("own", *[c.alias(k) for k, c in rule_ensemble.features(F.col("_stat")).items()]).collect():
            want = own_features(r["own"])
            assert list(want) == names and all(r[k] == pytest.approx(want[k], abs=1e-12) for k in names)


def test_scores_are_the_models(spark, docs, sf):
    model = rule_ensemble.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    b, rules, names = model
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in rule_ensemble.scored(docs, model, ["doc_id"]).collect():
        x = own_features(texts[r["doc_id"]])
        total = b + sum(w for path, w in rules if all((x[names[j]] <= c) if side == "<=" else (x[names[j]] > c) for j, side, c in path))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)


def own_votes(s):
    n, chars = s["n_words"], s["word_chars"]
    over = lambda a, b, p: s[a] * 100 > s[b] * p
    even = n > 0 and 3 * n <= chars <= 9 * n and not over("n_symbols", "n_words", 2) and not over("n_upper", "word_chars", 15) and not over("n_marks", "n_words", 10)
    varied = even and not over("n_dup_lines", "n_lines", 5) and not over("n_repeat_words", "n_words", 5)
    bad = [n < 20, n > 0 and (chars < 2 * n or chars > 12 * n), over("n_symbols", "n_words", 10), over("n_dup_lines", "n_lines", 30), over("n_repeat_words", "n_words", 20), over("n_upper", "word_chars", 40), over("n_marks", "n_words", 40)]
    return tuple([-int(x) for x in bad] + [int(even), int(varied)])


def test_votes_and_posteriors(docs, odd):
    """EM over single documents, each in every step, gives the posterior that counted patterns give."""
    for df in (docs, odd):
        rows = weak_rules.judged(weak_rules.statistics(df)).collect()
        names = list(weak_rules.rules())
        votes = [tuple(r[k] for k in names) for r in rows]
        assert votes == [own_votes(r) for r in rows]
        good = [0.1 if -1 in v else 0.9 for v in votes]
        accuracy = [weak_rules.BELIEF] * len(names)
        for _ in range(400):
            for j in range(len(names)):
                cast = [(g, v[j]) for g, v in zip(good, votes, strict=True) if v[j]]
                right = sum(g if x > 0 else 1 - g for g, x in cast)
                held = 1 + weak_rules.WEIGHT * len(cast)
                accuracy[j] = (right + weak_rules.BELIEF * held) / (len(cast) + held)
            good = [1 / (1 + math.exp(-sum(x * math.log(a / (1 - a)) for x, a in zip(v, accuracy, strict=True)))) for v in votes]
        for r, g in zip(rows, good, strict=True):
            assert r["posterior"] == pytest.approx(g, abs=1e-5) and r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5)
        assert len(collections.Counter(votes)) > 1

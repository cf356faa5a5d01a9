"""Quality classifier: a sparse ensemble of rules.

Small boosted trees over statistics of whole texts are fitted on labelled documents; each path from a root becomes a conjunctive
rule; a lasso-penalised logistic regression keeps few of them; the result is compiled into one Spark column expression,
so that scoring any number of documents needs built-in functions only.

Fitting uses at most `SAMPLE` labelled documents, those of least hashed doc_id. Without labels of both kinds every score
is 0.5. Null texts count as empty ones and are scored like them. Several labels of one doc_id: the least quality
holds. Labels of unknown documents and null labels play no part. Equal texts get equal scores. Other columns are never read and
go along whatever their names where documents are filtered. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .text_stats import SYMBOLS, count, dup_lines, let, word_chars, words

#: Most labelled documents that a fit reads.
SAMPLE = 20_000
#: Folds by crc32(doc_id as text); fold 0 is held out.
FOLDS = 5
DECIDE = 0.3


def features(s: Column) -> dict[str, Column]:
    """Features from the struct of statistics(); ratios are over words or characters and 0 without any."""
    over = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    n, chars = s["n_words"], s["word_chars"]
    return {
        "n_words": n.cast("double"),
        "word_length": over(chars, n),
        "distinct": over(s["n_distinct"], n),
        "symbols": over(s["n_symbols"], n),
        "marks": over(s["n_marks"], n),
        "upper": over(s["n_upper"], chars),
        "digits": over(s["n_digits"], chars),
        "stops": over(s["n_stops"], n),
        "dup_lines": over(s["n_dup_lines"], s["n_lines"]),
        "line_words": over(n, s["n_lines"]),
        "echoes": over(s["n_echoes"], n),
    }


def counts(text: Column, w: Column) -> Column:
    """A struct of counts over a whole text and its words."""
    parts = {
        "n_words": F.size(w).cast("long"),
        "n_distinct": F.size(F.array_distinct(w)).cast("long"),
        # Words that equal the next word or the one after it.
        "n_echoes": (F.size(w) - F.size(F.filter(w, lambda x, i: F.coalesce((x != F.get(w, i + 1)) & (x != F.get(w, i + 2)), F.lit(True))))).cast("long"),
        "word_chars": word_chars(text),
        "n_symbols": count(text, SYMBOLS),
        "n_marks": count(text, "[!?]"),
        "n_upper": count(text, r"\p{Lu}"),
        "n_digits": count(text, r"[0-9]"),
        "n_stops": count(text, r"[.,;:]"),
        "n_lines": count(text, r"\n") + 1,
        "n_dup_lines": dup_lines(text),
    }
    return F.struct(*[c.alias(k) for k, c in parts.items()])


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns and `_stat`, the counts over the whole text."""
    rows = docs.select(*keep, F.col("text").alias("_text"), words(F.col("text")).alias("_words"))
    return rows.select(*keep, counts(F.col("_text"), F.col("_words")).alias("_stat"))


# ---- fitting, on a bounded sample


def _tree(x: np.ndarray, edges: list[np.ndarray], residual: np.ndarray, columns: np.ndarray, depth: int, least: int) -> list[tuple]:
    """Paths of one regression tree: lists of (feature, '<=' or '>', threshold), inner nodes included. x: bin numbers."""
    paths: list[tuple] = []

    def grow(rows: np.ndarray, path: tuple) -> None:
        if path:
            paths.append(path)
        if len(path) == depth or len(rows) < 2 * least:
            return
        best = (1e-9, None)
        r = residual[rows]
        total, n = r.sum(), len(rows)
        for f in columns:
            b = x[rows, f]
            k = len(edges[f]) + 1
            sums, counts = np.cumsum(np.bincount(b, r, k))[:-1], np.cumsum(np.bincount(b, minlength=k))[:-1]
            ok = (counts >= least) & (n - counts >= least)
            if not ok.any():
                continue
            gain = np.where(ok, sums**2 / np.maximum(counts, 1) + (total - sums) ** 2 / np.maximum(n - counts, 1) - total**2 / n, 0)
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], (f, at))
        if best[1] is None:
            return
        f, at = best[1]
        left = x[rows, f] <= at
        grow(rows[left], (*path, (int(f), "<=", float(edges[f][at]))))
        grow(rows[~left], (*path, (int(f), ">", float(edges[f][at]))))

    grow(np.arange(len(x)), ())
    return paths


def holds(path: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, op, t in path:
        out &= x[:, f] <= t if op == "<=" else x[:, f] > t
    return out


def extract_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, seed: int = 7) -> list[tuple]:
    """Distinct conjunctions from the paths of boosted trees on random halves of rows and features."""
    random = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, 66)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    score, found = np.full(len(y), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), {}
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-score))
        rows = random.permutation(len(y))[: max(len(y) // 2, min(len(y), 200))]
        columns = random.permutation(x.shape[1])[: max(3, x.shape[1] * 2 // 3)]
        paths = _tree(bins[rows], edges, residual[rows], columns, depth, max(5, len(rows) // 200))
        for p in paths:
            found.setdefault(tuple(sorted(p)), None)
        for p in paths:
            if len(p) == depth:
                hit = holds(p, x)
                score[hit] += 0.3 * np.clip(residual[hit].sum() / max((np.abs(residual[hit]) * (1 - np.abs(residual[hit]))).sum(), 1e-6), -4, 4)
    return list(found)


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of an l1-penalised logistic regression, by accelerated proximal gradient steps."""
    n, m = z.shape
    lipschitz = 0.25 * (np.linalg.norm(z, 2) ** 2 / n + 1)
    w, b = np.zeros(m), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-np.clip(z @ v + c, -50, 50))) - y
        step = v - z.T @ g / n / lipschitz
        w2, b2 = np.sign(step) * np.maximum(np.abs(step) - penalty / lipschitz, 0), c - g.mean() / lipschitz
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return b, w


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.001) -> tuple[float, list[tuple[tuple, float]]]:
    """Intercept and (rule, weight) pairs."""
    if len(y) < 10 or y.min(initial=1) == y.max(initial=0):
        return 0.0, []
    rules = extract_rules(x, y)
    z = np.stack([holds(r, x) for r in rules], axis=1).astype("float32")
    spread = np.maximum(z.std(0), 0.05)
    b, w = lasso(z / spread, y, penalty)
    return b, [(r, float(a / s)) for r, a, s in zip(rules, w, spread, strict=True) if abs(a) > 1e-4]


def compiled(b: float, rules: list[tuple[tuple, float]], names: list[str], values: Column) -> Column:
    """The score as a column: logistic of the weights of the rules that hold. values: an array of the features."""
    at = {n: i for i, n in enumerate(names)}

    def weight_of(path: tuple, weight: float) -> Column:
        cond = None
        for i, op, t in path:
            v = F.get(values, F.lit(at[names[i]]))
            one = v <= t if op == "<=" else v > t
            cond = one if cond is None else cond & one
        return F.when(cond, weight).otherwise(0.0)

    terms = [F.lit(float(b)), *[weight_of(p, w) for p, w in rules]]
    while len(terms) > 1:  # in pairs, so that the expression stays shallow
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return 1 / (1 + F.exp(-terms[0]))


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[float, list, list[str]]:
    known = labels.filter("doc_id is not null and quality is not null").filter(fold(F.col("doc_id")) != 0)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # the documented bound of a fit
    ids = docs.sparkSession.createDataFrame(some.collect(), "doc_id long, _quality int")
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), ["doc_id", "_quality"])
    names = list(features(F.col("_stat")))
    narrow = rows.select("doc_id", "_quality", *[c.alias(k) for k, c in features(F.col("_stat")).items()])
    order = ["doc_id", "_quality", *names]
    got = narrow.orderBy(F.xxhash64("doc_id"), *order).limit(sample).toPandas().sort_values(order)  # where ids repeat, there are more rows than ids
    b, rules = fit(got[names].to_numpy("float64"), (got["_quality"] > 0).to_numpy("float64"))
    return b, rules, names


def scored(docs: DataFrame, model: tuple[float, list, list[str]], keep: list[str]) -> DataFrame:
    b, rules, names = model
    rows = statistics(docs, keep).select(*keep, F.array(*features(F.col("_stat")).values()).alias("_values"))
    return rows.select(*keep, compiled(b, rules, names, F.col("_values")).alias("score"))


def score(text: Column, model: tuple[float, list, list[str]]) -> Column:
    """The score as one expression that computes each part once wherever the optimiser puts it."""
    b, rules, names = model
    of = lambda stat: let(F.array(*features(stat).values()), lambda f: compiled(b, rules, names, f))
    return let(words(text), lambda w: let(counts(text, w), of))


def accepted(docs: DataFrame, labels: DataFrame, decide: float = DECIDE) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns."""
    return docs.filter(score(F.col("text"), train(docs, labels)) >= decide)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = scored(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return rows.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= DECIDE, 1).otherwise(0).alias("predicted"))

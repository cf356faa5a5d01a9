"""Quality rules as weak supervision.

Each rule reads statistics of a whole text and votes for good or bad or abstains. Expectation-maximisation over all documents
estimates how often each rule is right where it votes, and a document is kept by its posterior probability of being
good, not by passing every rule. Documents enter the estimate as counts of
vote patterns, of which there are at most 3 to the number of rules.

Null and empty texts have no words and fail the base rules. Equal rows are counted singly and fare alike; a posterior of just the
threshold keeps. Only doc_id and text are read, so other columns, whatever their names, play no part. An empty table gives no rows.
Only DataFrame operations touch documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .text_stats import SYMBOLS, count, dup_lines, repeat_words, word_chars, words

GOOD, BAD, NONE = 1, -1, 0
KEEP = 0.5


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics that rules read, from one pass over whole texts."""
    text, w = F.col("text"), F.col("_words")
    rows = docs.select("doc_id", "text", words(text).alias("_words"))
    return rows.select(
        "doc_id",
        F.size(w).cast("long").alias("n_words"),
        word_chars(text).alias("word_chars"),
        count(text, SYMBOLS).alias("n_symbols"),
        dup_lines(text).alias("n_dup_lines"),
        repeat_words(w).alias("n_repeat_words"),
        (count(text, r"\n") + 1).alias("n_lines"),
        count(text, r"\p{Lu}").alias("n_upper"),
        count(text, r"[!?]").alias("n_marks"),
    )


def over(part: str, whole: str, per_cent: int) -> Column:
    return F.col(part) * 100 > F.col(whole) * per_cent


def rules() -> dict[str, Column]:
    """Votes by rule. Rules of defects accuse or abstain; rules of evenness acquit or abstain."""
    n, chars = F.col("n_words"), F.col("word_chars")
    accuse = lambda c: F.when(c, BAD).otherwise(NONE)
    even = (n > 0) & (chars >= n * 3) & (chars <= n * 9) & ~over("n_symbols", "n_words", 2) & ~over("n_upper", "word_chars", 15) & ~over("n_marks", "n_words", 10)
    return {
        "v_short": accuse(n < 20),
        "v_word_length": accuse((n > 0) & ((chars < n * 2) | (chars > n * 12))),
        "v_symbols": accuse(over("n_symbols", "n_words", 10)),
        "v_dup_lines": accuse(over("n_dup_lines", "n_lines", 30)),
        "v_repeats": accuse(over("n_repeat_words", "n_words", 20)),
        "v_upper": accuse(over("n_upper", "word_chars", 40)),
        "v_marks": accuse(over("n_marks", "n_words", 40)),
        "v_even": F.when(even, GOOD).otherwise(NONE),
        "v_varied": F.when(even & ~over("n_dup_lines", "n_lines", 5) & ~over("n_repeat_words", "n_words", 5), GOOD).otherwise(NONE),
    }


#: What is believed of a rule's accuracy beforehand, and the weight of that belief as a share of its votes.
BELIEF, WEIGHT = 0.8, 0.1


def estimate(patterns: list[tuple[tuple[int, ...], int]], steps: int = 200) -> list[float]:
    """The accuracy of each rule where it votes, by EM over counted vote patterns.

    Both kinds of document are held equally likely beforehand, so that votes alone decide; a document without votes gets 0.5.
    """
    m = len(patterns[0][0]) if patterns else 0
    good = [0.1 if BAD in votes else 0.9 for votes, _ in patterns]
    accuracy = [BELIEF] * m
    for _ in range(steps):
        for j in range(m):
            cast = sum(n for votes, n in patterns if votes[j] != NONE)
            right = sum((g if votes[j] == GOOD else 1 - g) * n for g, (votes, n) in zip(good, patterns, strict=True) if votes[j] != NONE)
            held = 1 + WEIGHT * cast
            accuracy[j] = (right + BELIEF * held) / (cast + held)
        new = []
        for votes, _ in patterns:
            logit = sum(v * math.log(a / (1 - a)) for v, a in zip(votes, accuracy, strict=True))
            new.append(1 / (1 + math.exp(-max(-700.0, min(700.0, logit)))))
        moved, good = max((abs(a - b) for a, b in zip(good, new, strict=True)), default=0), new
        if moved < 1e-9:
            break
    return accuracy


def judged(stats: DataFrame, keep: float = KEEP) -> DataFrame:
    """stats with votes, `posterior` (probability of good), base_failed and kept."""
    voted = rules()
    rows = stats.withColumns({k: v.cast("int") for k, v in voted.items()})
    found = rows.groupBy(*voted).count().collect()  # at most 3 to the number of rules
    accuracy = estimate(sorted((tuple(r[k] for k in voted), r["count"]) for r in found))
    logit = F.lit(0.0)
    for name, a in zip(voted, accuracy, strict=False):
        logit = logit + F.col(name) * math.log(a / (1 - a))
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return rows.withColumn("posterior", 1 / (1 + F.exp(-logit))).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(cut(statistics(table(spark, sf_dir, "documents"))))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")

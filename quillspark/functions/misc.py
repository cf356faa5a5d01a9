"""Smaller scalar functions: names, prompts, settings, passwords."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, token_estimate, trim_text

#: Fixed values.
USERNAME = r"^[a-z0-9_.@-]+$"
ROUNDS = 260_000
RETRIED = (429, 502, 503, 504)


def username(name: Column) -> Column:
    """Stripped and lower-cased; null where other characters remain."""
    n = F.lower(strip(name))
    return F.when(n.rlike(USERNAME), n)


def bootstrap_users(raw: Column) -> Column:
    """An array of (username, password) from 'name:password' entries parted by commas, semicolons or line ends."""
    items = F.filter(F.split(raw, r"[,;\n]+"), lambda x: strip(x) != "")
    return F.transform(items, lambda x: F.struct(username(F.substring_index(x, ":", 1)).alias("username"), F.when(F.contains(x, F.lit(":")), strip(F.regexp_replace(x, r"^[^:]*:", ""))).alias("password")))


def token_digest(token: Column) -> Column:
    return F.sha2(token, 256)


def password_hash(password: Column, salt: Column, rounds: int = ROUNDS) -> Column:
    """PBKDF2 with SHA-256 as hex; salt as hex."""

    def run(p: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else hashlib.pbkdf2_hmac("sha256", a.encode(), bytes.fromhex(b), rounds).hex() for a, b in zip(p, s, strict=True)])

    return F.pandas_udf(run, "string")(password, salt)


def moment(text: Column) -> Column:
    """An ISO time; without a zone UTC; empty or broken: null, which callers replace by now."""
    return F.try_to_timestamp(F.nullif(strip(text), F.lit("")))


def context_line(place: Column, source: Column, score: Column) -> Column:
    return F.format_string("[%d] source=%s score=%.4f", place, source, score)


def classification_text(question: Column, history: Column, summary: Column) -> Column:
    """What a route classifier reads, each part within its budget and all within 4000 characters."""
    part = lambda label, c: F.when(strip(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f"{label}:\n"), c))
    return trim_text(F.concat_ws("\n\n", part("Question", strip(question)), part("History", trim_text(history, 3000, "tail")), part("Summary", trim_text(summary, 3000, "middle"))), 4000, "middle")


def messages(system: Column, summary: Column, history: Column, question: Column) -> Column:
    """An array of (role, content): system, remembered summary if any, history, question."""
    one = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    memory = F.when(F.coalesce(summary, F.lit("")) != "", F.array(one("system", summary))).otherwise(F.array().cast("array<struct<role: string, content: string>>"))
    return F.concat(F.array(one("system", system)), memory, F.coalesce(history, F.array().cast("array<struct<role: string, content: string>>")), F.array(one("user", question)))


def tokens_per_second(text: Column, ms: Column) -> Column:
    return F.when(ms > 0, token_estimate(text) / (ms / 1000)).otherwise(0.0)


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^a-zA-Z0-9_]+", "_")


def version_name(base: Column, seconds: Column, digest: Column) -> Column:
    return F.concat(safe_name(base), F.lit("__v"), seconds.cast("string"), F.lit("_"), F.substring(digest, 1, 12))


def config_digest(settings: Column) -> Column:
    """A digest of a map of settings, whatever the order of its keys."""
    pairs = F.array_sort(F.map_entries(settings))
    return F.sha2(F.to_json(pairs), 256)


def changed(before: list[Column], now: list[Column]) -> Column:
    out = F.lit(False)
    for b, n in zip(before, now, strict=True):
        out = out | ~b.eqNullSafe(n)
    return out


def backoff(first: float, most: float, tries: int) -> Column:
    """Delays before each retry: doubling, bounded."""
    return F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda i: F.least(F.lit(most), F.lit(first) * F.pow(F.lit(2.0), i)))


def health_status(degraded: Column, checked: Column) -> Column:
    return F.when(degraded, "degraded").when(F.coalesce(checked, F.lit(0)) <= 0, "unknown").otherwise("healthy")


def search_result(columns: dict[str, Column]) -> Column:
    """A result as JSON with its sixteen fields; missing ones get their defaults."""
    texts = ["source", "text", "content_type", "h1", "h2", "h3", "source_key", "retrieval_source"]
    numbers = {"chunk_id": -1, "start_line": -1, "end_line": -1}
    fields = [F.coalesce(columns.get(c, F.lit(None).cast("string")), F.lit("text" if c == "content_type" else "")).alias(c) for c in texts]
    fields += [F.coalesce(columns.get(c, F.lit(None).cast("int")), F.lit(d)).alias(c) for c, d in numbers.items()]
    fields += [F.coalesce(columns.get("headings", F.lit(None).cast("array<string>")), F.array().cast("array<string>")).alias("headings")]
    fields += [columns.get(c, F.lit(None).cast("double")).alias(c) for c in ("score", "vector_score", "bm25_score", "rerank_score")]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})

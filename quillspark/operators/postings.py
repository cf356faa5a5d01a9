"""Postings in blocks, and exact BM25 top-k for batches of questions that reads the blocks that can matter.

Documents are taken in windows, as they come: a block holds the postings of one token in one window. So nothing is shuffled to build blocks
but, for a stored index, the blocks themselves. A search deals blocks by window and scores each window's documents for all
questions at once, and only the best of each question leave a window. With upper bounds (the greatest weight in a block), the sum of a
question's bounds in a window tells whether a document there can be among its best: the windows of the greatest bounds are scored
first, and of the others those whose bound reaches the k-th best score that they gave.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lexical_tokens
from .lexical import B, K1, top

#: Documents in a window of an index that is built for one search, and of one that is kept.
WIDE, NARROW = 1024, 128
#: Terms of questions that are scored together.
TOGETHER = 200_000
#: Windows of a question that are scored before bounds are compared.
FIRST = 2
#: Windows up to which they are broadcast.
WINDOWS = 1 << 20
DIGITS, SLACK = 9, 1e-6


def blocks(docs: DataFrame, key: str, text: str = "text", *, only: DataFrame | None = None, wanted: Column | None = None, size: int = WIDE) -> DataFrame:
    """Rows (window, wanted, token, n, total, keys, tf, dl), one for each token in each window of `size` documents.

    The row without token sums a window up: documents with tokens and their tokens; these are the ones that statistics count. wanted: of
    which documents searches may tell; the others count in statistics alone. only: (token) of which alone blocks are made, where they are no more than TOGETHER.
    """
    flag = F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))
    rows = docs.select(F.col(key).alias("key"), lexical_tokens(F.col(text)).alias("tokens"), flag.alias("wanted"), F.spark_partition_id().alias("part"))
    asked = None
    if only is not None and (few := only.select("token").distinct()).count() <= TOGETHER:
        asked = few.toArrow().column("token").combine_chunks()
    kind = rows.schema["key"].dataType.simpleString()

    def one(b: pa.RecordBatch, window: int, ok: bool) -> pa.RecordBatch:
        lists, keys = b.column("tokens"), b.column("key")
        dl = np.diff(lists.offsets.to_numpy()).astype("int32")
        flat = lists.flatten()
        if asked is None:
            coded = flat.dictionary_encode()
            names, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype("int64")
        else:
            names, codes = asked, pc.fill_null(pc.index_in(flat, value_set=asked), -1).to_numpy(zero_copy_only=False).astype("int64")
        doc = np.repeat(np.arange(len(dl)), dl)
        known = codes >= 0
        pairs, tf = np.unique(codes[known] * max(1, len(dl)) + doc[known], return_counts=True)
        code, own = pairs // max(1, len(dl)), pairs % max(1, len(dl))
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.empty(0, "int64")
        n = np.diff(np.r_[starts, len(code)])
        offsets = pa.array(np.r_[starts, len(code), len(code)].astype("int32"))
        m = len(starts) + 1
        columns = [
            pa.array(np.full(m, window)),
            pa.array(np.full(m, ok)),
            pa.concat_arrays([names.take(pa.array(code[starts])), pa.nulls(1, names.type)]),
            pa.array(np.r_[n, (dl > 0).sum()].astype("int64")),
            pa.array(np.r_[np.zeros(len(n)), dl.sum()].astype("int64")),
            pa.ListArray.from_arrays(offsets, keys.take(pa.array(own))),
            pa.ListArray.from_arrays(offsets, pa.array(tf.astype("int32"))),
            pa.ListArray.from_arrays(offsets, pa.array(dl[own])),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["window", "wanted", "token", "n", "total", "keys", "tf", "dl"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                b = whole.slice(at, size)
                part, ok = b.column("part")[0].as_py(), b.column("wanted")
                for value in (True, False):
                    some = b.filter(pc.equal(ok, value))
                    if some.num_rows:
                        yield one(some, (part << 33) + number, value)
                        number += 1

    return rows.mapInArrow(run, f"window long, wanted boolean, token string, n long, total long, keys array<{kind}>, tf array<int>, dl array<int>")


def statistics(made: DataFrame) -> tuple[int, float]:
    """Documents with tokens, and their mean length."""
    r = made.filter("token is null").agg(F.sum("n").alias("n"), F.sum("total").alias("t")).first()
    return r["n"] or 0, (r["t"] or 0) / r["n"] if r["n"] else 1.0


def frequencies(made: DataFrame) -> DataFrame:
    return made.filter("token is not null").groupBy("token").agg(F.sum("n").alias("df"))


def weight(tf: Column, dl: Column, mean: float, k1: float = K1, b: float = B) -> Column:
    """What a posting weighs without its token's rarity."""
    return tf / (tf + k1 * (1 - b + b * dl / mean))


def bounded(made: DataFrame, mean: float) -> DataFrame:
    """Blocks with `most`, the greatest weight in each."""
    return made.withColumn("most", F.array_max(F.zip_with("tf", "dl", lambda t, d: weight(t, d, mean))))


@dataclass
class Terms:
    """Questions that are scored together: their ids, and by token their numbers and the weights of the token."""

    ids: list
    by_token: dict[str, tuple[np.ndarray, np.ndarray]]


def terms(asked: DataFrame, name: str, df: DataFrame, n: int) -> Iterator[Terms]:
    """Questions in lots of about TOGETHER terms; asked: (name, token, qf)."""
    lots = max(1, -(-asked.count() // TOGETHER))
    known = asked.join(df, "token")
    for lot in range(lots):
        rows = known.filter(F.pmod(F.xxhash64(name), F.lit(lots)) == lot).select(name, "token", "qf", "df").collect()
        ids = sorted({r[name] for r in rows})
        place = {q: i for i, q in enumerate(ids)}
        found: dict[str, list[tuple[int, float]]] = {}
        for r in rows:
            found.setdefault(r["token"], []).append((place[r[name]], r["qf"] * np.log(1 + (n - r["df"] + 0.5) / (r["df"] + 0.5))))
        yield Terms(ids, {t: (np.array([q for q, _ in x]), np.array([w for _, w in x])) for t, x in found.items()})


def asked_blocks(made: DataFrame, asked: Terms) -> DataFrame:
    """Blocks of the asked tokens, of which there are no more than TOGETHER or so."""
    tokens = list(asked.by_token)
    rows = made.filter("token is not null and wanted")
    if len(tokens) <= 1000:
        return rows.filter(F.col("token").isin(tokens))
    return rows.join(F.broadcast(made.sparkSession.createDataFrame([(t,) for t in tokens], "token string")), "token", "left_semi")


def _by_window(rows: DataFrame) -> DataFrame:
    # By a hash of the window: an exchange by the window itself is left out over a union of inputs that are dealt by it, though these may be coalesced apart.
    return rows.repartition(F.xxhash64("window")).sortWithinPartitions("window", F.col("token").asc_nulls_first())


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each window, of batches that are sorted by window."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        own = b.column("window").to_numpy()
        edges = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True]) if len(own) else np.empty(0, "int64")
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if held and held[0].column("window")[0].as_py() != own[s]:
                yield pa.Table.from_batches(held)
                held.clear()
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def scored(made: DataFrame, asked: Terms, name: str, kinds: tuple[str, str], mean: float, k: int, pairs: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(name, key, score) of the k best of each question in each window, with all that tie with the last. pairs: (window, q) to score, all where not given."""
    rows = asked_blocks(made, asked).select("window", "token", "keys", "tf", "dl", F.lit(None).cast("array<int>").alias("qs"))
    if pairs is not None:
        lists = pairs.groupBy("window").agg(F.collect_list("q").alias("qs"))  # at most the questions of one lot
        some = pairs.select("window").distinct()  # one number for each window of documents: these go to the blocks, which are not shuffled to be left out
        rows = rows.join(F.broadcast(some) if some.count() <= WINDOWS else some, "window", "left_semi").unionByName(lists, allowMissingColumns=True)
    ids = pa.array(asked.ids, {"int": pa.int32(), "bigint": pa.int64()}.get(kinds[0]))
    by_token = asked.by_token
    restricted = pairs is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _windows(batches):
            w = w.combine_chunks()
            chosen = np.ones(len(ids), bool)
            if restricted:
                chosen[:] = False
                chosen[np.array(w.column("qs")[0].as_py(), "int64")] = True
                w = w.slice(1)
            lists = w.column("keys").combine_chunks() if w.num_rows else None
            if lists is None or not len(lists):
                continue
            coded = lists.flatten().dictionary_encode()
            doc = coded.indices.to_numpy(zero_copy_only=False)
            tf, dl = (w.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("float64") for c in ("tf", "dl"))
            part = tf / (tf + k1 * (1 - b + b * dl / mean))
            edges = np.r_[0, np.cumsum(np.diff(lists.offsets.to_numpy()))]
            scores = np.zeros((len(ids), len(coded.dictionary)))
            for i, token in enumerate(w.column("token").to_pylist()):
                qs, weights = by_token[token]
                here = slice(edges[i], edges[i + 1])
                scores[qs[:, None], doc[here]] += weights[:, None] * part[here]
            scores = np.round(scores[chosen], DIGITS)
            keep = scores > 0
            if scores.shape[1] > k:
                keep &= scores >= -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
            q, d = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.flatnonzero(chosen)[q])), coded.dictionary.take(pa.array(d)), pa.array(scores[q, d])], names=["q", "key", "score"])

    out = _by_window(rows).mapInArrow(run, f"q {kinds[0]}, key {kinds[1]}, score double")
    return out.withColumnRenamed("q", name)


def bounds(made: DataFrame, asked: Terms) -> DataFrame:
    """(window, q, bound): what no document of the window passes for question number q; made: blocks with `most`, of which only the bounds are read."""
    by_token, n = asked.by_token, len(asked.ids)
    rows = asked_blocks(made, asked).select("window", "token", "most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _windows(batches):
            total = np.zeros(n)
            for token, most in zip(w.column("token").to_pylist(), w.column("most").to_pylist(), strict=True):
                qs, weights = by_token[token]
                total[qs] += weights * most
            some = np.flatnonzero(total > 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), w.column("window")[0].as_py())), pa.array(some.astype("int32")), pa.array(total[some])], names=["window", "q", "bound"])

    return _by_window(rows).mapInArrow(run, "window long, q int, bound double")


def placed(limits: DataFrame) -> DataFrame:
    """bounds with `place` among a question's windows, the greatest bound first."""
    top_ = Window.partitionBy("q").orderBy(F.desc("bound"), "window")
    return limits.withColumn("place", F.row_number().over(top_))


def needed(limits: DataFrame, one: DataFrame, asked: Terms, name: str, k: int) -> DataFrame:
    """(window, q) that the best of `one` leave open; limits: bounds with their place."""
    known = top(one, name, "score", "key", k).groupBy(name).agg(F.min("score").alias("least"), F.count("*").alias("n")).filter(F.col("n") >= k)
    least = {r[name]: r["least"] for r in known.collect()}  # a row for each question of a lot
    floor = one.sparkSession.createDataFrame([(i, least.get(q, 0.0)) for i, q in enumerate(asked.ids)], "q int, floor double")
    return limits.filter(F.col("place") > FIRST).join(F.broadcast(floor), "q").filter(F.col("bound") >= F.col("floor") - SLACK).select("window", "q")


def best(made: DataFrame, asked: DataFrame, name: str, k: int, n: int, mean: float, df: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(name, key, score, rank): the k best of each question, ties by key. asked: (name, token, qf). keep: writes a table that is read twice; without it bounds are not used."""
    key_kind = made.schema["keys"].dataType.elementType.simpleString()
    kinds = dict(asked.dtypes)[name], key_kind
    out = None
    for lot in terms(asked, name, df, n):
        if not lot.ids:
            continue
        if keep is None:
            both = scored(made, lot, name, kinds, mean, k)
        else:
            limits = keep(placed(bounds(made, lot)))
            one = keep(scored(made, lot, name, kinds, mean, k, limits.filter(F.col("place") <= FIRST)))
            both = one.unionByName(scored(made, lot, name, kinds, mean, k, needed(limits, one, lot, name, k)))
        out = both if out is None else out.unionByName(both)
    if out is None:
        out = asked.sparkSession.createDataFrame([], f"{name} {kinds[0]}, key {key_kind}, score double")
    return top(out, name, "score", "key", k)

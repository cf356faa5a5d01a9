"""Periodic runs of words, and texts without their repetition.

A run is a stretch of words whose smallest period is q, with at least `exponent` periods and `least` words, that no neighbouring
word extends at that period. Runs are found as Kolpakov and Kucherov do: a suffix automaton gives the Lempel-Ziv factors of the
words (the longest pieces that begin earlier as well), Main's algorithm finds the runs that touch the border of a factor, from common
extensions to both sides of it, and every run strictly inside a factor is copied from the earlier occurrence of that factor.

Before that, words that can be in no run are put aside: any three words in a row of a run recur in it a known number of times, so only
stretches of such triples are factorised, each by itself. No run crosses their ends.

A document is one row of one task, and nothing is shuffled; memory grows with the longest stretch (some 0.6 KB a word). Null and empty
texts have no runs and an empty collapsed text; equal rows are treated singly, extra columns go along whatever their names, and an empty
table gives no rows. Of several runs at one place each is reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import fresh, table, tidy
from .text_stats import words

LEAST, EXPONENT = 6, 4
KIND = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])


def factors(s: list[int]) -> list[tuple[int, int]]:
    """(start, earlier start) of each Lempel-Ziv factor; -1 where a letter is new. Factors may overlap their earlier occurrence."""
    to, link, size, first, last = [{}], [-1], [0], [-1], 0
    for i, c in enumerate(s):
        new = len(to)
        to.append({})
        size.append(i + 1)
        first.append(i)
        link.append(0)
        p = last
        while p != -1 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p != -1:
            q = to[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                split = len(to)
                to.append(to[q].copy())
                size.append(size[p] + 1)
                first.append(first[q])
                link.append(link[q])
                while p != -1 and to[p].get(c) == q:
                    to[p][c] = split
                    p = link[p]
                link[q] = link[new] = split
        last = new
    out, at, n = [], 0, len(s)
    while at < n:
        state, end, source = 0, at, -1
        while end < n:
            following = to[state][s[end]]
            begins = first[following] - (end - at)  # where what has been read occurs first
            if begins >= at:
                break
            state, end, source = following, end + 1, begins
        out.append((at, source))
        at = max(end, at + 1)
    return out


def prefixes(s: list[int]) -> list[int]:
    """For each place, how long a prefix of s begins there (0 at place 0)."""
    n = len(s)
    z, low, high = [0] * n, 0, 0
    for i in range(1, n):
        k = 0
        if i < high:
            k = z[i - low]
            if k < high - i:
                z[i] = k
                continue
            k = high - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        low, high = i, i + k
    return z


def at_border(s: list[int], a: int, b: int, e: int, least: int, exponent: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of runs that touch the border b between the factors s[a:b] and s[b:e], end by e, and none an earlier border has.

    Such a run starts after a - period, as the factor at a would be longer otherwise, so periods stay below (e - a) / (exponent - 1).
    """
    most = (e - a - 1) // (exponent - 1)
    if most < 1:
        return
    low, high = max(0, a - most), min(len(s), e + 1)
    right, left, whole = s[b:high], s[low:b][::-1], s[low:high]
    ahead, back = prefixes([*right, -1, *whole]), prefixes([*left, -1, *whole[::-1]])
    r, n = len(right), len(left)
    for p in range(1, min(most, n) + 1):  # the period before the border lies in the run
        end = b + ahead[r + 1 + n - p]
        start = b - p - (back[p] if p < n else 0)
        if end - start >= exponent * p and end - start >= least and end <= e and (end > b or start > a):
            yield start, end, p
    for p in range(1, min(most, r) + 1):  # the period after it does
        end = b + p + (ahead[p] if p < r else 0)
        start = b - back[n + 1 + r - p]
        if end - start >= exponent * p and end - start >= least and end <= e:
            yield start, end, p


def maximal_runs(s: list[int], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of s, by start, then period. exponent: 2 or more."""
    parts, n = factors(s), len(s)
    known: dict[int, dict[int, int]] = {}  # start -> end -> smallest period
    for i in range(1, len(parts) + 1):
        a, b, e = parts[i - 1][0], parts[i][0] if i < len(parts) else n, parts[i + 1][0] if i + 1 < len(parts) else n
        for start, end, p in at_border(s, a, b, e, least, exponent):
            ends = known.setdefault(start, {})
            ends[end] = min(p, ends.get(end, p))
        if i < len(parts) and (source := parts[i][1]) >= 0:
            shift = b - source
            for start in range(source + 1, e - shift - least):
                for end, p in known.get(start, {}).items():
                    if end < e - shift:
                        known.setdefault(start + shift, {})[end + shift] = p
    return sorted((start, end - start, p) for start, ends in known.items() for end, p in ends.items())


def stretches(ids: np.ndarray, least: int, exponent: int) -> list[tuple[int, int]]:
    """Stretches (start, end) of words outside which no run has a word; runs do not cross their ends.

    Three words in a row of a run recur in it exponent - 1 times or more (at period 1, as often as it has triples).
    """
    n, need = len(ids), min(exponent - 1, max(least, exponent) - 2)
    if n < least:
        return []
    if need < 2:
        return [(0, n)]
    m = int(ids.max()) + 1
    pairs = ids[:-1] * m + ids[1:]
    if m > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, triple, counts = np.unique(pairs[:-1] * m + ids[2:], return_inverse=True, return_counts=True)
    at, kinds = np.flatnonzero(counts[triple] >= need), len(counts)
    while len(at):
        group = np.cumsum(np.r_[True, np.diff(at) > 1]) - 1
        _, same, counts = np.unique(group * kinds + triple[at], return_inverse=True, return_counts=True)
        stays = (counts[same] >= need) & (np.bincount(group)[group] >= least - 2)
        if stays.all():
            edges = np.flatnonzero(np.r_[True, np.diff(at) > 1, True])
            return [(int(at[x]), int(at[y - 1]) + 3) for x, y in zip(edges[:-1], edges[1:], strict=True)]
        at = at[stays]
    return []


def runs_of(text: list[bytes], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text's words, by start, then period."""
    numbers = {w: i for i, w in enumerate(dict.fromkeys(text))}
    if len(text) - len(numbers) < least - max(1, least // exponent):  # a run repeats more words than that
        return []
    ids = np.fromiter(map(numbers.__getitem__, text), "int64", len(text))
    return [(x + start, size, p) for x, y in stretches(ids, least, exponent) for start, size, p in maximal_runs(ids[x:y].tolist(), least, exponent)]


def collapsed(text: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run repeats: all but those after the first period of a run."""
    if not found:
        return text
    gone = np.zeros(len(text) + 1, "int64")
    for start, size, p in found:
        gone[start + p] += 1
        gone[start + size] -= 1
    return [text[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


def periodic(docs: DataFrame, text: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """docs with `runs`, an array of (start, length, period) in words, by start, then period, and `collapsed`, the words that no run repeats joined by a space.

    Where docs has columns of these names, the new ones get an underscore.
    """
    names = [fresh(docs, "runs"), fresh(docs, "collapsed")]
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    place = docs.columns.index(text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bounds, values, left = [0], [], []
            for value in b.column(place).cast(pa.binary()):
                buffer = value.as_buffer()
                own = buffer.to_pybytes().split() if buffer is not None else []  # at the six ASCII white-space characters
                found = runs_of(own, least, exponent)
                values += found
                bounds.append(len(values))
                left.append(b" ".join(collapsed(own, found)))
            flat = pa.StructArray.from_arrays([pa.array([v[k] for v in values], "int64") for k in range(3)], fields=list(struct))
            lists = pa.ListArray.from_arrays(pa.array(bounds, "int32"), flat)
            yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(left, pa.binary()).view(pa.string())], names=[*b.schema.names, *names])

    return docs.mapInArrow(tidy(each), StructType([*docs.schema.fields, StructField(names[0], ArrayType(KIND)), StructField(names[1], StringType())]))


def planted(doc_id: Column, text: Column) -> Column:
    """The query's texts: of every tenth document by checksum, the words from one on are repeated with a period."""
    g = F.floor(F.crc32(doc_id.cast("string")) / 10).cast("long")

    def cycle(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int"))))

    chosen = F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))
    return F.when(chosen & text.isNotNull() & text.rlike(r"[^\x20\x09-\x0D]"), F.array_join(F.get(F.transform(F.array(words(text)), cycle), F.lit(0)), " ")).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    told = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rows = periodic(docs).withColumn("_best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        (-F.col("_best.l")).alias("length"),
        F.col("_best.period").alias("period"),
        F.expr("-1000 * _best.l div _best.period").alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

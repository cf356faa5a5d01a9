"""Removal of repeated passages by a distributed merge of sorted suffixes.

A byte goes when a string of `WINDOW` bytes that covers it also starts in a document of smaller id. Every such string has a
minimizer: the place in it whose next `SEED` bytes hash least. Equal strings have it at the same place, so it is
enough to sort the suffixes that begin at minimizers ("anchors").

1. Each task makes sorted runs of its anchors' fingerprints, dealt by range; where runs meet, fingerprints that occur in
   one document only are dropped, and the others go back to their documents with the count of documents that hold them.
2. Those documents are put in order of their least shared fingerprint, so that copies meet. Each task sorts the suffixes at
   their shared anchors into a run and settles the strings whose documents are all in the run.
3. What may have partners elsewhere is exchanged as front-coded sorted runs, which a loser tree merges by known common
   prefixes. In suffix order, strings that agree are neighbours whose common prefixes tell how far they agree.

Only one suffix of equal ones leaves a run (that of the least id), so that hot passages and large groups of copies stay small.
A run sends a row to each range for which it has something, so rows are no more than exchanged fingerprints or suffixes.
Strings that share all bytes from the anchor on are told apart by a 64-bit hash of the bytes before it: two unlike strings pass
for equal with a probability of about 2**-64 for each such pair.
Texts are told apart by two 64-bit hashes, of the text and of id and text; equal ones only are taken for one.
Null and empty texts have no bytes. Documents of equal ids remove nothing from one another; a null id counts as
larger than any other, 2**63 - 1 included. Texts shorter than the window stay. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop, offsets, ordered, partitions, table, tidy
from .loser_tree import decoded, front_coded, merge
from .shingle_join import _BASE, U, _tables, mix

WINDOW, SEED = 50, 20
SPAN = WINDOW - SEED + 1
SLICE = 1 << 20
#: Text bytes in one run of fingerprints, in one sorted run of suffixes, and in one range of the exchange.
RUN, SORTED, RANGE = 8 << 20, 4 << 20, 16 << 20
#: Most ids, and most bytes of spans, that are broadcast to spare texts a shuffle.
SMALL, SMALL_BYTES = 500_000, 48 << 20
#: Texts that go to a worker at once.
AT_ONCE = 1000
LARGE = (1 << 63) - 1
_VALUE = mix(np.arange(256, dtype="uint64") * U(0x1000193) + U(77))


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """The anchors of concatenated texts: place, fingerprint (48 bits), and first and last start of the windows that they stand for.

    ends: where each text ends. Windows lie inside one text; the leftmost of equal hashes is the minimizer.
    """
    found: list[tuple[np.ndarray, ...]] = []
    n = len(data)
    for at in range(0, max(n - WINDOW + 1, 0), SLICE):
        d = data[at : min(at + SLICE + WINDOW - 1, n)]
        windows = len(d) - WINDOW + 1
        power, inverse = _tables(len(d) + 1)
        total = np.zeros(len(d) + 1, "uint64")
        np.cumsum(_VALUE[d] * power[: len(d)], out=total[1:])
        h = mix((total[SEED:] - total[:-SEED]) * inverse[: len(d) - SEED + 1])
        least = (h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype="uint64")
        for step in (1, 2, 4, 8, SPAN - 16):
            least = np.minimum(least[:-step], least[step:])
        place = (least[:windows] & U(0xFFFFFFFF)).astype("int64")
        starts = np.arange(at, at + windows)
        inside = ends[np.searchsorted(ends, starts, side="right")] - starts >= WINDOW
        starts, place = starts[inside], place[inside]
        if not len(starts):
            continue
        first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)])
        last = np.r_[first[1:] - 1, len(starts) - 1]
        p = place[first]
        found.append((p + at, mix(h[p] ^ U(0x5DEECE66D)) >> U(16), starts[first], starts[last]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, "int64"), np.empty(0, "uint64"), np.empty(0, "int64"), np.empty(0, "int64"))


# SPAN - 16 must lie in 1..16 for the five steps above to cover SPAN places.
assert 1 <= SPAN - 16 <= 16


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), "uint8"), np.cumsum([len(t) for t in texts])


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Rows of some MB of text at a time."""
    held, total = [], 0
    for whole in batches:
        if not whole.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(whole.column("text")), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < whole.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
            held.append(whole.slice(at, to - at))
            total += int(ends[to - 1] - (ends[at - 1] if at else 0))
            at = to
            if total >= size:
                yield pa.Table.from_batches(held)
                held, total = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _held(part: np.ndarray) -> list[tuple[int, int, int]]:
    """(range, first, past the last) of the ranges that sorted range numbers name: no more of them than numbers, however many ranges there are."""
    edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, "int64")
    return [(int(part[s]), s, e) for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def _raw(column: pa.ChunkedArray) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


# ---- 1. fingerprints that several documents hold


def _fingerprint_runs(ranges: int):
    """Rows (part, own, docs, blob): sorted fingerprints of a run for a range, or with own those of one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered(batches, RUN):
            ids = t.column("id").to_numpy()
            data, ends = _joined(_raw(t.column("text")))
            place, prints, _, _ = anchors(data, ends)
            doc = np.searchsorted(ends, place, side="right")
            order = np.lexsort((doc, prints))
            prints, doc = prints[order], doc[order]
            new = np.r_[True, (prints[1:] != prints[:-1]) | (doc[1:] != doc[:-1])] if len(doc) else np.empty(0, bool)
            prints, doc = prints[new], doc[new]
            head = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]]) if len(doc) else np.empty(0, "int64")
            count = np.diff(np.r_[head, len(doc)])
            several = np.repeat(count > 1, count)
            parts, own, docs, blobs = [], [], [], []
            # Documents that share within the run need no answer; the range only learns that the fingerprint is shared.
            mine, theirs = doc[several], prints[several]
            by = np.argsort(mine, kind="stable")
            mine, theirs = mine[by], theirs[by]
            edge = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1], True]) if len(mine) else []
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                i = int(ids[mine[s]])
                parts.append(hash(i) % ranges)
                own.append(True)
                docs.append(np.array([i], "<i8").tobytes())
                blobs.append(theirs[s:e].tobytes() + bytes(e - s))
            value, who = prints[head], np.where(count > 1, np.uint32(0xFFFFFFFF), doc[head].astype("uint32"))
            part = (value * U(ranges)) >> U(48)
            for k, s, e in _held(part):
                if e > s:
                    gaps = np.diff(np.r_[U((k << 48) // ranges), value[s:e]])
                    who_, names = who[s:e], np.empty(0, "int64")
                    known = np.unique(who_[who_ != 0xFFFFFFFF])
                    names = ids[known]
                    local = np.where(who_ == 0xFFFFFFFF, np.uint32(0xFFFFFFFF), np.searchsorted(known, who_).astype("uint32"))
                    wide = bool(gaps.max() >> U(32)) or len(known) >= 0xFFFF
                    kinds = ("<u8", "<u4") if wide else ("<u4", "<u2")
                    local = local if wide else np.where(local == 0xFFFFFFFF, 0xFFFF, local)
                    parts.append(k)
                    own.append(False)
                    docs.append(names.astype("<i8").tobytes())
                    blobs.append(bytes([wide]) + gaps.astype(kinds[0]).tobytes() + local.astype(kinds[1]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(parts, "int32"), pa.array(own, "bool"), pa.array(docs, "binary"), pa.array(blobs, "binary")], names=["part", "own", "docs", "blob"])

    return run


def _shared(ranges: int):
    """Rows (slot, blob): packed (document, shared fingerprint, count of documents that hold it, 0: not known), dealt by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, owners, known = [], [], []
        for b in batches:
            for part, own, docs, blob in zip(*(b.column(c).to_pylist() for c in ("part", "own", "docs", "blob")), strict=True):
                if own:
                    n = len(blob) // 9
                    known.append((np.full(n, int.from_bytes(docs, "little", signed=True)), np.frombuffer(blob, "<u8", n), np.zeros(n, "uint8")))
                    continue
                wide = blob[0]
                n = (len(blob) - 1) // (12 if wide else 6)
                gaps = np.frombuffer(blob, "<u8" if wide else "<u4", n, 1).astype("uint64")
                local = np.frombuffer(blob, "<u4" if wide else "<u2", n, 1 + n * (8 if wide else 4)).astype("int64")
                names = np.r_[np.frombuffer(docs, "<i8"), -1]
                none = 0xFFFFFFFF if wide else 0xFFFF
                gaps[0] += U((part << 48) // ranges)
                values.append(np.cumsum(gaps, dtype="uint64"))
                owners.append((names[np.where(local == none, len(names) - 1, local)], local == none))
        if values:
            value = np.concatenate(values)
            owner, none = np.concatenate([o[0] for o in owners]), np.concatenate([o[1] for o in owners])
            del values, owners
            order = np.argsort(value, kind="stable")
            value, owner, none = value[order], owner[order], none[order]
            head = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
            count = np.diff(np.r_[head, len(value)])
            # A run that shares it among several of its documents makes the count unknown.
            hidden = np.add.reduceat(none, head) > 0
            docs = np.repeat(np.where(hidden | (count > 255), 0, count), count).astype("uint8")
            keep = np.repeat(count > 1, count) & ~none
            known.append((owner[keep], value[keep], docs[keep]))
        if not known:
            return
        owner, value, docs = (np.concatenate(x) for x in zip(*known, strict=True))
        slot = (mix(owner.view("uint64")) % U(ranges)).astype("int32")
        order = np.lexsort((owner, slot))
        owner, value, docs, slot = owner[order], value[order], docs[order], slot[order]
        edge = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1], True]) if len(slot) else []
        blobs = [owner[s:e].tobytes() + value[s:e].tobytes() + docs[s:e].tobytes() for s, e in zip(edge[:-1], edge[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(slot[edge[:-1]] if len(slot) else [], "int32"), pa.array(blobs, "binary")], names=["slot", "blob"])

    return run


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, least, prints): a document's shared fingerprints in order, eight bytes each, then their counts."""
    held = []
    for b in batches:
        for blob in b.column("blob").to_pylist():
            n = len(blob) // 17
            held.append((np.frombuffer(blob, "<i8", n), np.frombuffer(blob, "<u8", n, 8 * n), np.frombuffer(blob, "u1", n, 16 * n)))
    if not held:
        return
    owner, value, docs = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((value, owner))
    owner, value, docs = owner[order], value[order], docs[order]
    edge = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True])
    for at in range(0, len(edge) - 1, 5000):
        part = list(zip(edge[:-1][at : at + 5000], edge[1:][at : at + 5000], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([int(owner[s]) for s, _ in part], "int64"), pa.array([int(value[s]) for s, _ in part], "int64"), pa.array([value[s:e].tobytes() + docs[s:e].tobytes() for s, e in part], "binary")], names=["id", "least", "prints"])


# ---- 2. and 3. sorted suffixes


def covered(prints: np.ndarray, lcp: np.ndarray, left: np.ndarray, ids: np.ndarray, late: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For suffixes in order: which of their windows (SPAN columns by the anchor's place in the window) start in a smaller id, too.

    lcp: bytes shared with the suffix before, from the anchor on. left: the SPAN - 1 bytes before each anchor, nearest first.
    low, high: the range of columns that a suffix stands for. late: suffixes of documents without id, which come after all ids.
    """
    out = np.zeros((len(ids), SPAN), bool)
    hash_ = np.zeros(len(ids), "uint64")
    for k in range(SPAN):
        if k:
            hash_ = mix(hash_ + left[:, k - 1].astype("uint64") + U(1))
        group = np.cumsum(lcp < WINDOW - k)  # equal from the anchor on, as far as this window goes
        rows = np.flatnonzero((low <= k) & (k <= high))
        if len(rows) < 2:
            continue
        order = rows[np.lexsort((hash_[rows], group[rows]))]
        g, x, i, without = group[order], hash_[order], ids[order], late[order]
        head = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (x[1:] != x[:-1])])
        least, some, n = np.minimum.reduceat(i, head), np.logical_or.reduceat(~without, head), np.diff(np.r_[head, len(order)])
        out[order, k] = (i > np.repeat(least, n)) | (without & np.repeat(some, n))
    return out


def _intervals(rows: np.ndarray, starts: np.ndarray) -> list[tuple[int, bytes]]:
    """(row, pairs of first and past-last byte) of windows by row."""
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    if not len(rows):
        return []
    new = np.r_[True, (rows[1:] != rows[:-1]) | (starts[1:] > starts[:-1] + WINDOW)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(rows)] - 1
    r, a, b = rows[first], starts[first], starts[last] + WINDOW
    edge = np.flatnonzero(np.r_[True, r[1:] != r[:-1], True])
    return [(int(r[s]), np.stack([a[s:e], b[s:e]], axis=1).astype("<u4").tobytes()) for s, e in zip(edge[:-1], edge[1:], strict=True)]


_OUT = ["part", "key", "tag", "blob", "tail"]
OUT = "part int, key long, tag long, blob binary, tail binary"
#: What goes along with an exchanged suffix: key and tag of its text, its id or that it has none, start, columns, bytes before it.
TAIL = np.dtype([("key", "<i8"), ("id", "<i8"), ("late", "?"), ("tag", "<i8"), ("place", "<i8"), ("low", "u1"), ("high", "u1"), ("left", "u1", SPAN - 1)])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    part, key, tag, blob, tail = zip(*rows, strict=True) if rows else ([],) * 5
    return pa.RecordBatch.from_arrays([pa.array(part, "int32"), pa.array(key, "int64"), pa.array(tag, "int64"), pa.array(blob, "binary"), pa.array(tail, "binary")], names=_OUT)


def _sorted_runs(ranges: int):
    """Rows with part -1: settled intervals of a document; others: a front-coded run of suffixes for a range, and its tails."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """(key, tag, text, fingerprints, id) of some MB of text. The row of a key's fingerprints comes before those of its texts."""
        note, held, size = b"", [], 0
        for b in batches:
            for key, tag, text, blob, i in zip(*(b.column(c).to_pylist() for c in ("key", "tag", "raw", "prints", "id")), strict=True):
                if blob is not None:
                    note = blob
                    continue
                held.append((key, tag, text or b"", note, i))
                size += len(held[-1][2])
                if size >= SORTED:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in gathered(batches):
            keys_, tags = (np.array([r[k] for r in rows], "int64") for k in (0, 1))
            without = np.array([r[4] is None for r in rows])
            ids = np.array([LARGE if r[4] is None else r[4] for r in rows], "int64")
            data, ends = _joined([r[2] for r in rows])
            place, prints, first, last = anchors(data, ends)
            doc = np.searchsorted(ends, place, side="right")
            docs = np.zeros(len(place), "int64")
            keep = np.zeros(len(place), bool)
            edge = np.searchsorted(doc, np.arange(len(ids) + 1))
            for i, (_, _, _, note, _) in enumerate(rows):
                n = len(note) // 9
                value, count = np.frombuffer(note, "<u8", n), np.frombuffer(note, "u1", n, 8 * n)
                s, e = edge[i], edge[i + 1]
                at = np.minimum(np.searchsorted(value, prints[s:e]), len(value) - 1)
                keep[s:e] = value[at] == prints[s:e]
                docs[s:e] = count[at]
            del rows
            place, prints, first, last, doc, docs = (x[keep] for x in (place, prints, first, last, doc, docs))
            if not len(place):
                continue
            begin = np.r_[0, ends[:-1]][doc]
            after, before = (ends[doc] - place)[:, None], (place - begin)[:, None]
            padded = np.concatenate([np.zeros(SPAN - 1, "uint8"), data, np.zeros(WINDOW, "uint8")])
            right = np.where(np.arange(WINDOW) < after, sliding_window_view(padded, WINDOW)[place + SPAN - 1], np.uint8(0))
            left = np.where(np.arange(SPAN - 1) < before, sliding_window_view(padded, SPAN - 1)[place][:, ::-1], np.uint8(0))
            words = np.zeros((len(place), 56), "uint8")
            words[:, :WINDOW] = right
            keys = np.ascontiguousarray(words).view(">u8").astype("uint64")
            order = np.lexsort((*keys.T[::-1], prints))
            place, prints, first, last, doc, docs, right, left, begin = (x[order] for x in (place, prints, first, last, doc, docs, right, left, begin))
            lcp = np.zeros(len(place), "int64")
            differ = right[1:] != right[:-1]
            lcp[1:] = np.where(prints[1:] != prints[:-1], 0, np.where(differ.any(1), differ.argmax(1), WINDOW))
            low, high = place - last, place - first
            done = covered(prints, lcp, left, ids[doc], without[doc], low, high)
            r, k = np.nonzero(done)
            out = [(-1, int(keys_[i]), int(tags[i]), blob, None) for i, blob in _intervals(doc[r], (place[r] - begin[r]) - k)]
            # Fingerprints all of whose documents are here are settled; of the rest, suffixes with a window that none covers go on.
            head = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]])
            size = np.diff(np.r_[head, len(prints)])
            pairs = np.unique(np.stack([np.repeat(np.arange(len(head)), size), doc]), axis=1)
            here = np.bincount(pairs[0], minlength=len(head))
            open_ = np.repeat(here != docs[head], size) & ((high - low + 1) > done.sum(1))
            i = np.flatnonzero(open_)
            part = (prints[i] * U(ranges)) >> U(48)
            tail = np.zeros(len(i), TAIL)
            tail["key"], tail["id"], tail["late"] = keys_[doc[i]], ids[doc[i]], without[doc[i]]
            tail["tag"], tail["place"], tail["low"], tail["high"], tail["left"] = tags[doc[i]], place[i] - begin[i], low[i], high[i], left[i]
            head8 = np.zeros((len(i), 8), "uint8")
            head8[:] = prints[i].astype(">u8").view("uint8").reshape(-1, 8)
            text = np.concatenate([head8[:, 2:], right[i]], axis=1)
            for p, s, e in _held(part):
                rows = text[s:e]
                differ = rows[1:] != rows[:-1]
                shared = np.r_[0, np.where(differ.any(1), differ.argmax(1), rows.shape[1])]
                out.append((p, None, None, front_coded([x.tobytes() for x in rows], shared.tolist()), tail[s:e].tobytes()))
            for at in range(0, len(out), 5000):
                yield _batch(out[at : at + 5000])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals from the merge of all runs of a range."""
    by: dict[int, list[tuple[bytes, bytes]]] = {}
    for b in batches:
        for part, blob, tail in zip(*(b.column(c).to_pylist() for c in ("part", "blob", "tail")), strict=True):
            by.setdefault(part, []).append((blob, tail))
    for part in sorted(by):
        runs = by.pop(part)
        tails = [np.frombuffer(t, TAIL) for _, t in runs]
        start = np.cumsum([0, *map(len, tails)])
        seen = [0] * len(runs)
        order, lcp = np.empty(start[-1], "int64"), np.empty(start[-1], "int64")
        for n, (r, _, shared) in enumerate(merge([decoded(b) for b, _ in runs])):
            order[n] = start[r] + seen[r]
            seen[r] += 1
            lcp[n] = shared
        t = np.concatenate(tails)[order]
        new = lcp < 6  # the six bytes of the fingerprint come first
        done = covered(np.cumsum(new), np.where(new, 0, lcp - 6), t["left"], t["id"], t["late"], t["low"], t["high"])
        r, k = np.nonzero(done)
        names, row = np.unique(np.stack([t["key"][r], t["tag"][r]]), axis=1, return_inverse=True)
        out = [(-1, int(names[0, i]), int(names[1, i]), blob, None) for i, blob in _intervals(row.ravel(), t["place"][r] - k)]
        for at in range(0, len(out), 5000):
            yield _batch(out[at : at + 5000])


# ---- the operator


def repeats(docs: DataFrame) -> DataFrame:
    """(key, tag, spans): for documents with bytes to remove, lists of pairs of 32-bit offsets. docs: key, id, tag, text.

    All is dealt by key, a hash of id and text; ids are compared only. So documents without id, or of one id, are spread like others.
    Equal texts without id fare alike, and one of them is looked at.
    """
    same = docs.filter("id is null").groupBy("key", "tag").agg(F.first("id").alias("id"), F.first("text").alias("text"))
    docs = docs.filter("id is not null").unionByName(same)
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    ranges = max(1, -(-size // RANGE))
    runs = docs.select(F.col("key").alias("id"), "text").mapInArrow(tidy(_fingerprint_runs(ranges)), "part int, own boolean, docs binary, blob binary")
    shared = runs.repartitionById(ranges, F.col("part")).mapInArrow(tidy(_shared(ranges)), "slot int, blob binary")
    held = cut(shared.repartitionById(ranges, F.col("slot")).mapInArrow(tidy(_by_document), "id long, least long, prints binary").withColumnRenamed("id", "key"), AT_ONCE)
    few = held.count() <= SMALL  # beyond this size both sides are shuffled
    some = held.select("key", "least")
    sized = docs.join(F.broadcast(some) if few else some, "key").groupBy("key").agg(F.min("least").alias("least"), F.sum(F.octet_length("text")).alias("b"))
    sorted_ = ordered(sized, [F.col("least"), F.col("key")], partitions(docs.sparkSession))
    before, total = offsets(sorted_, F.sum("b"))
    inside = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col("_before") + F.coalesce(F.sum("b").over(inside), F.lit(0))
    # Buckets of equal bytes, not of equal rows: a long text counts as what it is.
    place = cut(sorted_.join(F.broadcast(before), "_part").select("key", "least", F.floor(upto * ranges / (total + 1)).cast("int").alias("bucket")))
    drop(sorted_)
    at = F.broadcast(place) if few else place
    texts = docs.join(at, "key").select("bucket", "least", "key", "id", "tag", F.encode("text", "UTF-8").alias("raw"), F.lit(None).cast("binary").alias("prints"))
    notes = held.drop("least").join(at, "key").select("bucket", "least", "key", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("tag"), F.lit(None).cast("binary").alias("raw"), "prints")
    both = texts.unionByName(notes).repartitionById(ranges, F.col("bucket")).sortWithinPartitions("least", "key", F.col("prints").isNull())
    settled = cut(both.select("key", "tag", "raw", "prints", "id").mapInArrow(tidy(_sorted_runs(ranges)), OUT), AT_ONCE)
    drop(held, place)
    more = settled.filter(F.col("part") >= 0).repartitionById(ranges, F.col("part")).mapInArrow(tidy(_merged), OUT)
    return settled.filter(F.col("part") < 0).unionByName(more).groupBy("key", "tag").agg(F.collect_list("blob").alias("spans"))


def cleaned(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns, `kept` (the bytes left), n_bytes, n_removed and n_spans of each document. docs: doc_id and text."""
    id_ = F.col("doc_id").cast("long")
    named = docs.withColumn("_key", F.xxhash64(F.lit(1), id_, "text")).withColumn("_tag", F.xxhash64("text"))
    spans = cut(repeats(named.select(F.col("_key").alias("key"), id_.alias("id"), F.col("_tag").alias("tag"), "text")), AT_ONCE)
    some = spans.select(F.col("key").alias("_key"), F.col("tag").alias("_tag"), "spans")
    size = spans.agg(F.sum(F.aggregate("spans", F.lit(64), lambda a, x: a + F.octet_length(x))).alias("b")).first()["b"] or 0
    joined = named.join(F.broadcast(some) if size <= SMALL_BYTES else some, ["_key", "_tag"], "left")  # broadcast only after this check
    rest = joined.filter(F.col("spans").isNull())
    joined = joined.filter(F.col("spans").isNotNull())
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                kept, counts = [], []
                for raw, blobs in zip(_raw(b.column("text")), b.column("spans").to_pylist(), strict=True):
                    removed = n = 0
                    if blobs:
                        spans = sorted(tuple(x) for blob in blobs for x in np.frombuffer(blob, "<u4").reshape(-1, 2).tolist())
                        pieces, end = [], 0
                        for a, z in spans:
                            if a > end or not n:
                                pieces.append(raw[end:a])
                                n += 1
                            removed += max(0, z - max(a, end))
                            end = max(end, z)
                        left = b"".join([*pieces, raw[end:]])
                    else:
                        left = raw
                    kept.append(left)
                    counts.append((len(raw), removed, n))
                columns = [b.column(c) for c in keep] + [pa.array(kept, "binary")] + [pa.array([c[i] for c in counts], "int64") for i in range(3)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "kept", "n_bytes", "n_removed", "n_spans"])

    out = joined.select(*dict.fromkeys([*keep, "text"]), "spans").mapInArrow(tidy(run), f"{schema}, kept binary, n_bytes long, n_removed long, n_spans long")
    whole = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    same = rest.select(*keep, whole.alias("kept"), F.octet_length(whole).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"))
    return out.unionByName(same)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut out of their texts; a character that is cut in two goes with the cut; n_chars follows.

    The other columns travel as one, so that their names do not matter. A null text becomes empty.
    """
    row = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    rows = cleaned(docs.select("doc_id", "text", row), ["row"])
    valid = F.pandas_udf(lambda raw: raw.map(lambda b: b.decode("utf-8", "ignore")), "string")
    out = rows.select("row", valid("kept").alias("text"))
    of = {c: F.col("row").getField(c).alias(c) for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in of:
        of["n_chars"] = F.length("text").cast("long").alias("n_chars")
    return out.select(*[of[c] for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaned(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

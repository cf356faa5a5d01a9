"""N-gram Jaccard self-join: size-aware, heavy and light.

A document's set are its distinct word n-grams (64-bit hashes; texts of fewer words have their whole sequence as one).
Documents of equal sets form one class. Classes of small sets enumerate the subsets of fixed sizes that a partner must share
with them; classes of large sets are found in inverted lists, scanned for the rarest n-grams of each set (as many as a
partner cannot all miss). The boundary between small and large is where the estimated cost is least. An entry knows how many
members of its set stand from it on, in the order of rank; of a pair's common n-grams the first has enough on both sides, so a
list keeps only entries that have such a partner in it. Lists that are long are dealt into pairs of blocks. Members of a short
list are compared in pairs at once; members of a long one are first compared with one head of it, drawn anew for each list, and
what these links join is not compared again. Pairs are compared by size and by a parity bitmap (which bounds the difference of
two sets from below), in lists folded to as few bits as still tell unlike sets apart. Sets too large for one bitmap are cut into
slices by hash. The similarity of two sets is no greater than that of their most similar slice, so such sets are listed slice by
slice, with the rarest n-grams, the size and the bitmap of each slice, and a pair need pass in one slice only. All bitmaps
together, then the whole sets verify a pair.

N-grams are 64-bit hashes throughout: of sets with s n-grams in all, some two different ones agree with a probability of
about s * s / 2**65, and that would shift a similarity by one n-gram.

Null and empty texts have no set and link with nothing. Rows without doc_id take part; their component is that of their
text. Equal rows fall into one class. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, fresh, partitions, table, tidy
from .components import components

#: The largest boundary between light and heavy sets that is considered.
LIGHT = 24
#: Bits of the bitmap of a slice, and the set size from which a set has more slices than one: four times as many for each four times as large.
BITS = 1024
SLICED = 1024
#: Members of a block of a long list.
BLOCK = 2048
#: The longest lists whose entries without a partner are left out before they get bitmaps, and that are compared at once.
SHORT = 256
SLICE = 1 << 20
#: Most rows (of four numbers) that are broadcast.
SMALL = 200_000
#: Occurrences in so many n-grams from which a task reports an n-gram.
SEEN, COUNTED = 3, 1_500_000
#: Pairs that a task gathers before it passes them on.
TOGETHER = 1 << 18

U = np.uint64
_MIX = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15))
_BASE = U(0x9E3779B97F4A7C55)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = x + _MIX[2]
    x = (x ^ (x >> U(30))) * _MIX[0]
    x = (x ^ (x >> U(27))) * _MIX[1]
    return x ^ (x >> U(31))


def _tables(size: int, held: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """Powers of the base and of its inverse modulo 2**64."""
    if size > held.get("size", 0):
        inverse = U(pow(int(_BASE), -1, 1 << 64))
        n = max(size, SLICE + (1 << 16))
        powers = [np.cumprod(np.r_[U(1), np.full(n, b, "uint64")], dtype="uint64") for b in (_BASE, inverse)]
        if n > 4 * SLICE:
            return powers[0], powers[1]
        held |= {"size": n, "powers": powers}
    return held["powers"][0], held["powers"][1]


_VALUE = mix(np.arange(256, dtype="uint64") * U(0x1000003))
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), "uint8")
    if not len(data):
        return [np.empty(0, "uint64") for _ in texts]
    space = _SPACE[data]
    edges = np.flatnonzero(np.diff(np.r_[True, space, True].astype("int8")))
    starts, ends = edges[0::2], edges[1::2]
    power, inverse = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, "uint64")
    np.cumsum(_VALUE[data] * power[: len(data)], out=total[1:])
    word = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype("uint64"))
    ends_at = np.cumsum([len(r) + 1 for r in raw])
    first = np.searchsorted(starts, np.r_[0, ends_at])
    constants = mix(np.arange(1, width + 1, dtype="uint64"))
    n = len(word)
    grams = np.zeros(max(n - width + 1, 0), "uint64")
    for k in range(width):
        grams += word[k : n - width + 1 + k] * constants[k] if len(grams) else grams
    grams = mix(grams)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            out.append(mix(np.array([(word[a:b] * constants[: b - a]).sum(dtype="uint64") + U(b - a)], "uint64")))
        else:
            out.append(np.empty(0, "uint64"))
    return out


class Threshold:
    """Jaccard similarity of at least num / den, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, n, m):
        """Least intersection of sets of n and m members that link."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def least(self, n):
        """Least size of a partner."""
        return -(-self.num * n // self.den)

    def most(self, n):
        """Greatest size of a partner."""
        return self.den * n // self.num

    def differ(self, n, m):
        """In how many members sets of n and m that link differ at most."""
        return n + m - 2 * self.overlap(n, m)

    def width(self) -> int:
        """Bits, BITS at most, by which unlike sets of any size below SLICED differ in more than sets that link, by two standard deviations."""
        bits = 64
        while bits < BITS and bits / 2 - self.differ(SLICED - 1, SLICED - 1) < bits**0.5:
            bits *= 2
        return bits

    def prefix(self, n):
        return n - self.least(n) + 1

    def sizes(self, n: int) -> list[int]:
        """The sizes of subsets that a light set of n enumerates: all overlaps with any partner."""
        return sorted({self.overlap(n, m) for m in range(self.least(n), self.most(n) + 1)})

    def subsets(self, n: int) -> int:
        return sum(math.comb(n, c) for c in self.sizes(n) if c <= n)


def _slices(batch: pa.RecordBatch, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _lists(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.empty(0, "uint64")
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]).astype("int32")), pa.array(flat.view("int64")))


def slices(n: int) -> int:
    """How many slices a set of n members has: some 256 to 1024 members each."""
    r = 1
    while n >= SLICED * r:
        r *= 4
    return r


def parity(s: np.ndarray, r: int) -> np.ndarray:
    """Bitmaps of the r slices, one after the other. Bit i of a slice: whether an odd number of its members hash to i."""
    at = ((s >> U(40)) & U(r - 1)) * U(BITS) + (s & U(BITS - 1))
    return np.packbits(np.bincount(at.astype("int64"), minlength=BITS * r) & 1)


def _folded(bits: np.ndarray, r: int) -> np.ndarray:
    """The bitmaps of r slices from those of r or more; a slice of fewer is made up of whole slices of more."""
    return np.bitwise_xor.reduce(bits.reshape(-1, r * BITS // 8), axis=0)


def _brief(bits: np.ndarray, width: int) -> np.ndarray:
    """Each slice's bitmap of BITS folded to width bits: as if its members had been hashed to fewer."""
    return np.bitwise_xor.reduce(bits.reshape(-1, BITS // width, width // 8), axis=1).reshape(-1)


def common_grams(docs: DataFrame, width: int) -> np.ndarray:
    """Hashes of n-grams that make up a millionth or more of all documents' sets (so a million at most), sorted.

    They stand last in the order of every set, which keeps inverted lists short. The order is free: links do not depend on it. Each
    task reports what it sees `SEEN` times in some MB of text; their sums are compared with all documents' sizes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def report() -> pa.RecordBatch:
            grams, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, "uint64"), np.empty(0, "int64"))
            often = counts >= SEEN
            return pa.RecordBatch.from_arrays([pa.array(np.r_[grams[often].view("int64"), 0]), pa.array(np.r_[counts[often], 0]), pa.array(np.r_[np.zeros(often.sum(), "int64"), counts.sum()])], names=["gram", "n", "all"])

        for whole in batches:
            for b in _slices(whole):
                held += shingle_sets(b.column("text").to_pylist(), width)
                size += sum(map(len, held[-b.num_rows :]))
                if size > COUNTED:
                    yield report()
                    held.clear()
                    size = 0
        yield report()

    seen = cut(docs.select("text").mapInArrow(tidy(run), "gram long, n long, all long"))
    total = seen.agg(F.sum("all").alias("t")).first()["t"] or 0
    often = seen.groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(2 * SEEN, total // 1_000_000))
    found = np.sort(np.array([r["gram"] for r in often.select("gram").collect()], "int64").view("uint64"))
    drop(seen)
    return found


def sketches(docs: DataFrame, width: int, t: Threshold, common: np.ndarray) -> DataFrame:
    """doc_id, hash of the text, row, set size n, 128-bit signature of the set, its members if light, postings and bitmaps. docs: doc_id, text, row.

    keys, slots and rest are the list entries by which the set is scanned: key of the list, place of the slice in bits and sizes, which
    hold the bitmaps and sizes of the set's own slices and then, where smaller partners have fewer, of fewer slices, and how many
    members the slice has from this one on. brief holds the bitmaps folded for comparisons in lists.
    """
    fold = t.width()

    def ranked(s: np.ndarray) -> np.ndarray:
        if not len(common) or not len(s):
            return s
        often = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
        return np.concatenate([s[~often], s[often]])

    def entries(s: np.ndarray, r: int, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys, slots and rests of each slice's first n-grams in the order of rank, and the sizes of the slices."""
        if r == 1:
            first = ranked(s)[: t.prefix(len(s))]
            return first, np.full(len(first), at), len(s) - np.arange(len(first)), np.array([len(s)])
        own = ((s >> U(40)) & U(r - 1)).astype("int64")
        order = np.argsort(own, kind="stable")
        keys, slots, rest = [], [], []
        for part in np.split(s[order], np.flatnonzero(np.diff(own[order])) + 1):
            keys.append(mix(ranked(part)[: t.prefix(len(part))] + U(r)))
            slots.append(np.full(len(keys[-1]), at + int((part[0] >> U(40)) & U(r - 1))))
            rest.append(len(part) - np.arange(len(keys[-1])))
        return np.concatenate(keys), np.concatenate(slots), np.concatenate(rest), np.bincount(own, minlength=r)

    def sketch(s: np.ndarray) -> tuple[list[np.ndarray], bytes, bytes]:
        if not len(s):
            return [s, *[np.empty(0, "int64")] * 3], b"", b""
        r, low = slices(len(s)), slices(t.least(len(s)))
        bits = [parity(s, r)]
        found, at = [entries(s, r, 0)], r
        while low < r:  # smaller partners have fewer slices
            r //= 4
            bits.append(_folded(bits[0], r))
            found.append(entries(s, r, at))
            at += r
        whole = np.concatenate(bits)
        return [np.concatenate(x) for x in zip(*found, strict=True)], whole.tobytes(), _brief(whole, fold).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole):
                sets = shingle_sets(b.column("text").to_pylist(), width)
                n = np.array([len(s) for s in sets], "int64")
                one = np.array([s.sum(dtype="uint64") for s in sets], "uint64")
                two = np.array([mix(s).sum(dtype="uint64") for s in sets], "uint64")
                rows = [sketch(s) for s in sets]
                small = [s if len(s) <= LIGHT else s[:0] for s in sets]
                columns = [b.column("doc_id"), b.column("hash"), b.column("row"), pa.array(n), pa.array(one.view("int64")), pa.array(two.view("int64")), _lists(small), *[_lists([r[0][k] for r in rows]) for k in range(4)], *[pa.array([r[k] for r in rows], "binary") for k in (1, 2)]]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "hash", "row", "n", "s1", "s2", "small", "keys", "slots", "rest", "sizes", "bits", "brief"])

    return docs.select("doc_id", F.xxhash64("text").alias("hash"), "text", "row").mapInArrow(tidy(run), "doc_id long, hash long, row long, n long, s1 long, s2 long, small array<long>, keys array<long>, slots array<long>, rest array<long>, sizes array<long>, bits binary, brief binary")


def boundary(sizes: dict[int, int], t: Threshold, list_length: float) -> int:
    """The set size up to which enumerating subsets costs least in all. sizes: classes by set size, up to LIGHT."""
    best = (math.inf, 0)
    for b in range(LIGHT + 1):
        lists = lambda n: t.prefix(n) * (1 + list_length)
        cost = sum(k * (t.subsets(n) if n <= b else lists(n)) + k * (t.prefix(n) if t.least(b + 1) <= n <= b else 0) for n, k in sizes.items())
        best = min(best, (cost, b))
    return best[1]


def _subset_keys(rows: DataFrame, t: Threshold) -> DataFrame:
    """(key, node, n) for each subset of the fixed sizes of each light set of n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, nodes, sizes = [np.empty(0, "uint64")], [np.empty(0, "int64")], [np.empty(0, "int64")]
            for node, members in zip(b.column("node").to_pylist(), b.column("small").to_pylist(), strict=True):
                s = mix(np.array(members, "int64").view("uint64"))
                n, total = len(s), s.sum(dtype="uint64")
                for c in t.sizes(n):
                    if c <= n:
                        gone = list(combinations(range(n), n - c))
                        less = s[np.array(gone)].sum(axis=1, dtype="uint64") if n > c else np.zeros(1, "uint64")
                        keys.append(np.unique(mix(total - less + U(c))))
                        nodes.append(np.full(len(keys[-1]), node))
                        sizes.append(np.full(len(keys[-1]), n))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view("int64")), *[pa.array(np.concatenate(x)) for x in (nodes, sizes)]], names=["key", "node", "n"])

    return rows.select("node", "small").mapInArrow(tidy(run), "key long, node long, n long")


def _short() -> int:
    """The longest lists that are judged and compared as wholes; they are of one block."""
    return min(SHORT, BLOCK)


def _paired(entries: DataFrame, t: Threshold, rooted: bool = False) -> DataFrame:
    """The list entries (key, node, slot, n, rest, c, root) without those that no other of their list may link with, and c as what is left.

    c: entries of the list. A list is judged where its c entries follow one another, as they do after a join that sorts by key;
    lists of more than SHORT entries, and those that Spark has split, stay as they are. rooted: only an entry of another root may be a partner.
    """
    names, most = ["key", "node", "slot", "n", "rest", "c", "root"], _short()

    def kept(b: pa.RecordBatch) -> pa.RecordBatch:
        key, n, rest, c, root = (b.column(x).to_numpy() for x in ("key", "n", "rest", "c", "root"))
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        sizes, starts = np.diff(cuts), cuts[:-1]
        whole = (sizes == c[starts])
        keep, left = np.ones(len(key), bool), c.copy()
        for k in np.unique(sizes[whole]).tolist():
            lists, lot = starts[whole & (sizes == k)], max(1, (1 << 20) // (k * k))
            for a in range(0, len(lists), lot):
                at = lists[a : a + lot, None] + np.arange(k)
                fits = np.minimum(rest[at][:, :, None], rest[at][:, None]) >= t.overlap(n[at][:, :, None], n[at][:, None])
                fits &= (root[at][:, :, None] != root[at][:, None]) if rooted else ~np.eye(k, dtype=bool)
                keep[at] = found = fits.any(axis=2)
                left[at] = found.sum(axis=1)[:, None]
        return pa.RecordBatch.from_arrays([pa.array(left) if x == "c" else b.column(x) for x in names], names=names).filter(pa.array(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last batch's last list so far

        def close() -> Iterator[pa.RecordBatch]:
            b = pa.Table.from_batches(held).combine_chunks().to_batches()
            held.clear()
            yield from map(kept, b)

        for batch in batches:
            long = pc.greater(batch.column("c"), most)
            if pc.any(long).as_py():
                yield pa.RecordBatch.from_arrays(batch.columns, names=names).filter(long)
            new = batch.filter(pc.invert(long))
            if not new.num_rows:
                continue
            key = new.column("key").to_numpy()
            other = np.flatnonzero(key != key[-1])
            start = int(other[-1]) + 1 if len(other) else 0
            if start:
                held.append(new.slice(0, start))
                yield from close()
            elif held and held[-1].column("key")[-1].as_py() != key[0]:
                yield from close()
            held.append(new.slice(start))
        if held:
            yield from close()

    return entries.select(*names).mapInArrow(tidy(run), "key long, node long, slot int, n long, rest long, c long, root long")


def _compare(members: DataFrame, t: Threshold, heads: bool) -> DataFrame:
    """Pairs (a, b) of members (key, i, j, side, node, n, rest, bits, root) of one list block pair that may link.

    heads: of long lists only pairs with the list's head; of those of SHORT entries at most all pairs are compared, and each member's
    first one that may link is taken. The entries that are left to compare follow as rows (a, null) with key, slot, n, rest and c;
    members have slot and c then.
    """
    left, most = ["key", "slot", "n", "rest", "c"], _short()

    def pairs(node, n, rest, bits, side, root) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rows = np.zeros(1, "int64") if heads else np.arange(len(node))
        for at in range(0, len(rows), 256):
            r = rows[at : at + 256]
            fits = (np.minimum(rest[r][:, None], rest) >= t.overlap(n[r][:, None], n)) & (r[:, None] < np.arange(len(node)))
            if not heads:
                fits &= (root[r][:, None] != root) & ((side[r][:, None] != side) | (side[r][:, None] == -1))
            x, y = np.nonzero(fits)
            for c in range(0, len(x), 1 << 16):
                p, q = r[x[c : c + (1 << 16)]], y[c : c + (1 << 16)]
                ok = np.bitwise_count(bits[p] ^ bits[q]).sum(axis=1, dtype="int64") <= t.differ(n[p], n[q])
                yield node[p[ok]], node[q[ok]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def batch(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
            x, y = np.concatenate(a), np.concatenate(b)
            x, y = np.minimum(x, y), np.maximum(x, y)
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])][: len(x)]
            none = [pa.nulls(int(new.sum()), "int32" if c == "slot" else "int64") for c in left if heads]
            return pa.RecordBatch.from_arrays([pa.array(x[new]), pa.array(y[new]), *none], names=["a", "b", *left[: len(none)]])

        def short(lists, k, node, n, rest, bits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The ends of the taken pairs of whole lists of k entries that begin at these places, and which entries have other pairs that may link."""
            at = lists[:, None] + np.arange(k)
            x, y = at[:, :, None], at[:, None]
            ok = (np.minimum(rest[x], rest[y]) >= t.overlap(n[x], n[y])) & np.tri(k, k, -1, dtype=bool)
            u, i, j = np.nonzero(ok)
            ok[u, i, j] = np.bitwise_count(bits[at[u, i]] ^ bits[at[u, j]]).sum(axis=1, dtype="int64") <= t.differ(n[at[u, i]], n[at[u, j]])
            u, i = np.nonzero(ok.any(axis=2))
            j = ok[u, i].argmax(axis=1)
            ok[u, i, j] = False
            return node[at[u, i]], node[at[u, j]], ok.any(axis=2) | ok.any(axis=1)

        def close() -> Iterator[pa.RecordBatch]:
            g = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            key = [g.column(c).to_numpy() for c in ("key", "i", "j")]
            node, n, rest, side, root = (g.column(c).to_numpy() for c in ("node", "n", "rest", "side", "root"))
            bits = np.frombuffer(b"".join(g.column("bits").to_pylist()), "uint64").reshape(len(node), -1)
            cuts = np.flatnonzero(np.r_[True, (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1]), True])
            starts, sizes = cuts[:-1], np.diff(cuts)
            if heads:
                a, b = [], []
                c = g.column("c").to_numpy().copy()
                keep, whole = np.ones(len(node), bool), c[starts] <= most
                for k in np.unique(sizes[whole]).tolist():
                    lists, lot = starts[whole & (sizes == k)], max(1, (1 << 16) // (k * k))
                    for at in range(0, len(lists), lot):
                        p, q, more = short(lists[at : at + lot], k, node, n, rest, bits)
                        a.append(p)
                        b.append(q)
                        places = lists[at : at + lot, None] + np.arange(k)
                        keep[places], c[places] = more, more.sum(axis=1)[:, None]
                if a:
                    yield batch(a, b)
                if keep.any():
                    columns = [g.column("node"), pa.nulls(len(node), "int64"), *[pa.array(c) if x == "c" else g.column(x) for x in left]]
                    yield from pa.table(columns, names=["a", "b", *left]).filter(pa.array(keep)).combine_chunks().to_batches()
                starts, sizes = starts[~whole], sizes[~whole]
            x = starts[sizes == 2]  # most lists: all at once
            y = x + 1
            ok = (np.minimum(rest[x], rest[y]) >= t.overlap(n[x], n[y])) & (np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype="int64") <= t.differ(n[x], n[y]))
            if not heads:
                ok &= (root[x] != root[y]) & ((side[x] != side[y]) | (side[x] == -1))
            a, b = [node[x[ok]]], [node[y[ok]]]
            size = int(ok.sum())
            for s, e in zip(starts[sizes > 2].tolist(), (starts + sizes)[sizes > 2].tolist(), strict=True):
                for p, q in pairs(node[s:e], n[s:e], rest[s:e], bits[s:e], side[s:e], root[s:e]):
                    a.append(p)
                    b.append(q)
                    size += len(p)
                    if size >= TOGETHER:
                        yield batch(a, b)
                        a, b, size = [], [], 0
            if a:
                yield batch(a, b)

        for new in batches:  # whole lists only: what the last key of a batch has waits for the next
            if not new.num_rows:
                continue
            key = [new.column(c).to_numpy() for c in ("key", "i", "j")]
            last = len(key[0]) - 1
            other = np.flatnonzero((key[0] != key[0][last]) | (key[1] != key[1][last]) | (key[2] != key[2][last]))
            start = int(other[-1]) + 1 if len(other) else 0
            if start:
                held.append(new.slice(0, start))
                yield from close()
            elif held and any(held[-1].column(c)[-1].as_py() != k[0] for c, k in zip(("key", "i", "j"), key, strict=True)):
                yield from close()
            held.append(new.slice(start))
        if held:
            yield from close()

    if heads:
        return members.mapInArrow(tidy(run), "a long, b long, key long, slot int, n long, rest long, c long")
    return members.mapInArrow(tidy(run), "a long, b long").distinct()


def _close(pairs: DataFrame, rows: DataFrame, t: Threshold) -> DataFrame:
    """The pairs whose bitmaps of all slices, which grow with the sets, do not rule a link out."""
    left = pairs.join(rows.select(F.col("row").alias("a"), F.col("n").alias("m"), F.col("bits").alias("x")), "a")
    both = left.join(rows.select(F.col("row").alias("b"), "n", F.col("bits").alias("y")), "b").select("a", "b", "m", "n", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for m, n, x, y in zip(batch.column("m").to_pylist(), batch.column("n").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
                r = min(slices(m), slices(n))
                p, q = (_folded(np.frombuffer(z.as_buffer(), "uint8", slices(k) * BITS // 8), r) for z, k in ((x, m), (y, n)))
                keep.append(min(m, n) >= t.least(max(m, n)) and int(np.bitwise_count(p ^ q).sum(dtype="int64")) <= t.differ(m, n))
            yield batch.select(["a", "b"]).filter(pa.array(keep, "bool"))

    return both.mapInArrow(tidy(run), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """The pairs whose whole sets link."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), "uint64"), np.frombuffer(y.as_buffer(), "uint64")
                keep.append(len(np.intersect1d(p, q, assume_unique=True)) >= t.overlap(len(p), len(q)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, "bool"))

    return both.mapInArrow(tidy(run), "a long, b long")


def link_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id: the least doc_id that links of similarity num / den or more reach."""
    placed = _placed(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), width, num, den)
    least = cut(placed.groupBy("root").agg(F.min("doc_id").alias("component_id")))  # a table of its own, so that a large component's rows can be split in the join
    return placed.join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _placed(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """doc_id, set size n, row and root of each row; rows of one component, and no others, have the same root. docs: doc_id, text, row."""
    t, spark = Threshold(num, den), docs.sparkSession
    rows = cut(sketches(docs, width, t, common_grams(docs, width)))
    classes = cut(rows.filter("n > 0").groupBy("s1", "s2").agg(F.min("row").alias("node")))
    nodes = classes.select(F.col("node").alias("row"))
    nodes = F.broadcast(nodes) if classes.count() <= 2 * SMALL else nodes  # a number for each class: some MB at most
    reps = rows.join(nodes, "row", "left_semi").withColumnRenamed("row", "node")

    some = rows.filter(F.col("n") <= LIGHT).groupBy("n").count().collect()  # at most LIGHT rows
    posted = rows.select(F.explode("keys").alias("key")).agg(F.count("*").alias("n"), F.approx_count_distinct("key").alias("d")).first()
    light = boundary({r["n"]: r["count"] for r in some}, t, posted["n"] / max(posted["d"], 1))

    scanned = reps.filter(F.col("n") >= t.least(light + 1)).select("node", "sizes", F.explode(F.arrays_zip("keys", "slots", "rest")).alias("e"))
    lists = scanned.select(F.col("e.keys").alias("key"), "node", F.col("e.slots").cast("int").alias("slot"), F.element_at("sizes", F.col("e.slots").cast("int") + 1).alias("n"), F.col("e.rest").alias("rest"))
    posts = lists.unionByName(_subset_keys(reps.filter(F.col("n") <= light), t).withColumns({"slot": F.lit(0), "rest": F.col("n")}))
    shared = posts.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    live = cut(_paired(posts.join(shared, "key").withColumn("root", F.lit(0).cast("long")), t))
    size, blocks = t.width() // 8, F.ceil(F.col("c") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")

    def drawn(entries: DataFrame) -> DataFrame:
        """List entries with the folded bitmap of their slice, the number of blocks and their own."""
        whole = entries.join(rows.select(F.col("row").alias("node"), "brief"), "node")
        return whole.withColumn("bits", F.substring("brief", F.col("slot") * size + 1, F.lit(size))).withColumn("k", blocks).withColumn("m", mine)

    parts = partitions(spark)
    draw = F.when(F.col("c") <= _short(), F.col("node")).otherwise(F.xxhash64("key", "node"))
    whole = drawn(live).select("key", "slot", "c", F.col("m").alias("i"), F.lit(0).alias("j"), F.lit(-1).alias("side"), "node", "n", "rest", "bits", "root")
    first = cut(_compare(whole.repartition(parts, "key", "i").sortWithinPartitions("key", "i", draw), t, heads=True))
    tried = cut(first.filter("b IS NOT NULL").select("a", "b").distinct())
    near = cut(_close(tried, rows, t))
    links = cut(_verified(near, _set_rows(docs, rows, near, width), t))
    joined = components(links)

    # What the links have joined is not compared again, nor what no bitmap in its list is near to. Within one block all pairs count (side -1), between two blocks only those across.
    rooted = first.filter("b IS NULL").drop("b").withColumnRenamed("a", "node").join(joined.withColumnRenamed("root", "r"), "node", "left").withColumn("root", F.coalesce("r", "node")).drop("r")
    mixed = cut(rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("key"))
    apart = cut(_paired(rooted.join(mixed, "key"), t, rooted=True))
    dealt = drawn(apart).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    side = F.when(F.col("o") == F.col("m"), F.lit(-1)).otherwise(F.col("m"))
    rest = dealt.select("key", F.least("m", "o").alias("i"), F.greatest("m", "o").alias("j"), side.alias("side"), "node", "n", "rest", "bits", "root")
    others = _compare(rest.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "n", "node"), t, heads=False)
    untried = cut(others.join(tried, ["a", "b"], "left_anti"))
    others = cut(_close(untried, rows, t))
    more = cut(_verified(others, _set_rows(docs, rows, others, width), t))
    roots = components(links.unionByName(more))

    placed = rows.select("doc_id", "n", "row", "s1", "s2").join(classes, ["s1", "s2"], "left").join(roots, "node", "left").select("doc_id", "n", "row", F.coalesce("root", "node", -1 - F.col("row")).alias("root"))
    placed = cut(placed)
    drop(live, first, mixed, apart, tried, untried, near, others, links, more, rows, classes, joined, roots)
    return placed


def _set_rows(docs: DataFrame, rows: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """node and its whole set as bytes, for the nodes of some pairs."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    wanted = rows.select("doc_id", "hash", "row", "s1", "s2").join(nodes, "row", "left_semi")
    if nodes.count() <= SMALL:
        wanted = F.broadcast(wanted)  # its size has just been checked; beyond it texts are shuffled
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.xxhash64("d.text") == F.col("w.hash"))
    texts = docs.select("doc_id", "text").alias("d").join(wanted.alias("w"), same).select("text", "row", "s1", "s2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole):
                sets = shingle_sets(b.column("text").to_pylist(), width)
                # Texts of one hash may differ: only the one of this row's signature is meant.
                same = [int(s.sum(dtype="uint64").view("int64")) == x and int(mix(s).sum(dtype="uint64").view("int64")) == y for s, x, y in zip(sets, b.column("s1").to_pylist(), b.column("s2").to_pylist(), strict=True)]
                out = pa.RecordBatch.from_arrays([b.column("row"), pa.array([s.tobytes() for s in sets], "binary")], names=["node", "members"])
                yield out.filter(pa.array(same))

    return texts.mapInArrow(tidy(run), "node long, members binary").dropDuplicates(["node"])


def distinct_documents(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of docs for each component, whatever its doc_id: that of the least doc_id, rows without one last, and of these the first.

    Rows are numbered in a scratch table, so that equal or missing doc_ids are told apart. Null and empty texts link with nothing and stay.
    """
    name = fresh(docs, "row")
    numbered = cut(docs.withColumn(name, F.monotonically_increasing_id()))
    placed = _placed(numbered.select("doc_id", "text", F.col(name).alias("row")), width, num, den)
    kept = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias(name))
    return numbered.join(kept.select(name), name, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"), 3, 90, 100)

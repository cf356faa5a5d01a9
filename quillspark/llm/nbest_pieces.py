"""SentencePiece encoding and decoding with N-best segmentation.

The lattice of a text has an edge for each vocabulary piece at each place. A forward Viterbi pass gives the best score from the
start to every place; used as heuristic of a backward A* search it is exact, so that whole paths leave the queue in
order of falling score. No piece holds certain pairs of neighbours; between such a pair every path passes, so the lattice
falls apart there. The forward pass runs over all distinct parts of some texts at once, in arrays. It also gives the least cost of
leaving a part's best path; the N best paths of a text leave the best one in its N - 1 cheapest parts only, so the backward
search runs in those, and the paths of a text are merged from its parts best-first.

Scores are log-probabilities of pieces. A model file of merges holds ranks (whole numbers, 0, -1, -2 ...) instead, from which
sums would prefer many short pieces; they become probabilities by the law of Zipf and Mandelbrot, proportional to
1 / (rank + SHIFT), where nothing is trained. Files with other scores are taken at their word. All scores are rounded to multiples of
2**-20, so that sums do not depend on their order. A character without a piece becomes its UTF-8 bytes, at
`UNKNOWN` below the lowest ordinary score. A space is written as the mark U+2581 and one is put before the text, as the model file
says; its text normalisation is the identity.

Null and empty texts have no tokens, score 0 and one segmentation. A text that holds U+2581 itself does not come back (round_trip
false). Fewer segmentations than asked are returned where fewer exist. Of equal scores the path with the longer last pieces
comes first. Equal rows are independent; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import heapq
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spans, table, tidy

MARK = "▁"
N = 4
UNKNOWN = 10.0
SHIFT = 2.7
GRAIN = 2.0**-20
#: Text bytes whose parts go through the lattice together, bytes of a part up to which they do, and searches that a worker remembers.
SLICE, SHORT, REMEMBER = 1 << 20, 48, 20_000
_SLOTS = 18
_loaded: dict = {}
U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def log_probabilities(scores: list[float]) -> list[float]:
    """Scores of ordinary pieces as log-probabilities; ranks of merges become some by their order."""
    ranks = [-s for s in scores if s > -1e8]
    if ranks and all(r == int(r) >= 0 for r in ranks) and len(set(ranks)) == len(ranks):
        total = math.log(sum(1 / (r + SHIFT) for r in ranks))
        scores = [-math.log(-s + SHIFT) - total if s > -1e8 else s for s in scores]
    return [round(s / GRAIN) * GRAIN for s in scores]


class Pieces:
    """The vocabulary and scores of a model file, and segmentation with them."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        plain = [i for i in every if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        texts = [sp.id_to_piece(i) for i in every]
        scores = log_probabilities([sp.get_score(i) for i in plain])
        self.known = {texts[i]: (i, s) for i, s in zip(plain, scores, strict=True)}
        self.bytes = {int(texts[i][3:5], 16): i for i in every if sp.is_byte(i)}
        self.unk, self.longest = sp.unk_id(), max(map(len, self.known), default=1)
        self.unknown = min((s for s in scores if s > -1e8), default=0.0) - UNKNOWN
        # What each id stands for, with spaces for marks.
        turned = {v: bytes([k]) for k, v in self.bytes.items()}
        raw = [turned.get(i, t.replace(MARK, " ").encode("utf-8", "surrogatepass")) for i, t in enumerate(texts)]
        self.raw_size = np.array([len(r) for r in raw])
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.raw = np.frombuffer(b"".join(raw), "uint8")
        self.byte_ids = np.array([self.bytes.get(b, self.unk) for b in range(256)])
        self.scores = np.zeros(len(texts))
        self.scores[plain] = scores
        # Neighbours that some piece holds, and all within a character.
        self.pairs = np.zeros((256, 256), bool)
        self.pairs[:, 0x80:0xC0] = True
        for i in plain:
            r = np.frombuffer(raw[i], "uint8")
            self.pairs[r[:-1], r[1:]] = True
        self._plant([(raw[i], i) for i in plain])
        self.searches: dict[tuple[str, int], list[tuple[float, bytes]]] = {}

    def _plant(self, words: list[tuple[bytes, int]]) -> None:
        """The trie of pieces as a hash table from (node, byte) to node, and the piece that ends at each node."""
        nodes: dict[int, int] = {}
        ends = [-1]
        for text, i in words:
            node = 0
            for b in text:
                key = node << 8 | b
                if key not in nodes:
                    nodes[key] = len(ends)
                    ends.append(-1)
                node = nodes[key]
            ends[node] = i
        self.deepest = max((len(t) for t, _ in words), default=1)
        self.ends = np.array(ends)
        self.bits = max(_SLOTS, (4 * len(nodes)).bit_length())
        self.slot_key, self.slot_node = np.full(1 << self.bits, -1), np.zeros(1 << self.bits, "int64")
        keys, values = np.fromiter(nodes, "int64", len(nodes)), np.fromiter(nodes.values(), "int64", len(nodes))
        slots = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.slot_key[slots] == -1)
            free = free[np.unique(slots[free], return_index=True)[1]]
            self.slot_key[slots[free]], self.slot_node[slots[free]] = keys[free], values[free]
            left = np.ones(len(keys), bool)
            left[free] = False
            keys, values, slots = keys[left], values[left], (slots[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view("uint64") * _ODD) >> U(64 - self.bits)).astype("int64")

    def _step(self, nodes: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The nodes that a byte leads to, 0 where none."""
        keys = nodes << 8 | after
        slots = self._slot(keys)
        found = self.slot_key[slots]
        out = np.where(found == keys, self.slot_node[slots], 0)
        left = np.flatnonzero((found != keys) & (found != -1))
        while len(left):
            slots = (slots[left] + 1) & ((1 << self.bits) - 1) if len(slots) != len(left) else (slots + 1) & ((1 << self.bits) - 1)
            found = self.slot_key[slots]
            hit = found == keys[left]
            out[left[hit]] = self.slot_node[slots[hit]]
            on = ~hit & (found != -1)
            left, slots = left[on], slots[on]
        return out

    def forward(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Viterbi over parts (their bytes one after the other): counts and ids of the best paths, their scores, the costs of leaving them."""
        ends = np.cumsum(sizes)
        starts, part = ends - sizes, np.repeat(np.arange(len(sizes)), sizes)
        stop = ends[part]
        first = (flat & 0xC0) != 0x80
        width = np.select([flat < 0x80, flat < 0xE0, flat < 0xF0], [1, 2, 3], 4)
        width = np.minimum(width, stop - np.arange(len(flat)))
        single = ~first
        edges: list[list[np.ndarray]] = []
        at = np.flatnonzero(first)
        node = np.zeros(len(at), "int64")
        for size in range(1, self.deepest + 1):
            inside = at + size <= stop[at]
            if not inside.all():
                at, node = at[inside], node[inside]
            node = self._step(node, flat[at + size - 1].astype("int64"))
            alive = node > 0
            at, node = at[alive], node[alive]
            if not len(at):
                break
            piece = self.ends[node]
            ended = piece >= 0
            edges.append([at[ended], np.full(int(ended.sum()), size), piece[ended]])
            single[at[ended][width[at[ended]] == size]] = True
        lost = np.flatnonzero(~single)
        edges.append([lost, width[lost], np.full(len(lost), -1)])
        begin, size, piece = (np.concatenate(x) for x in zip(*edges, strict=True))
        score = np.where(piece >= 0, self.scores[piece], self.unknown)

        # By place in the part and, of one place, the longest first: each group has one edge for each part.
        offset = begin + size - starts[part[begin]]
        order = (offset * 256 + (255 - size)).astype("uint16").argsort(kind="stable")
        begin, size, piece, score, offset = begin[order], size[order], piece[order], score[order], offset[order]
        origin = begin + part[begin]  # places between bytes: one more in each part
        target = origin + size
        best = np.full(len(flat) + len(sizes), -np.inf)
        best[starts + np.arange(len(sizes))] = 0.0
        second, back = np.full(len(best), -np.inf), np.full(len(best), -1)
        groups = np.flatnonzero(np.r_[True, (offset[1:] != offset[:-1]) | (size[1:] != size[:-1]), True]) if len(begin) else np.zeros(1, "int64")
        for a, b in zip(groups[:-1].tolist(), groups[1:].tolist(), strict=True):
            to = target[a:b]
            here, old = best[origin[a:b]] + score[a:b], best[to]
            better = here > old
            second[to] = np.maximum(second[to], np.where(better, old, here))
            best[to] = np.where(better, here, old)
            back[to[better]] = np.arange(a, b)[better]

        final = ends + np.arange(len(sizes))
        gaps, now, who = np.full(len(sizes), np.inf), final.copy(), np.arange(len(sizes))
        left = starts + np.arange(len(sizes))
        steps = []
        while len(who):
            edge = back[now]
            gaps[who] = np.minimum(gaps[who], best[now] - second[now])
            steps.append((who, edge))
            now = origin[edge]
            on = now > left[who]
            now, who = now[on], who[on]
        owner, edge = (np.concatenate([s[k] for s in steps[::-1]]) if steps else np.empty(0, "int64") for k in (0, 1))
        order = owner.argsort(kind="stable")
        owner, edge = owner[order], edge[order]
        as_bytes = piece[edge] < 0
        spread = np.where(as_bytes & bool(self.bytes), size[edge], 1)
        ids = np.repeat(piece[edge], spread)
        lost = np.repeat(as_bytes, spread)
        if lost.any():
            ids[lost] = self.byte_ids[flat[spans(begin[edge], spread)[lost]]] if self.bytes else self.unk
        counts = np.bincount(owner, weights=spread, minlength=len(sizes)).astype("int64")
        return counts, ids.astype("int32"), best[final], gaps

    def search(self, part: str, n: int) -> list[tuple[float, list[int]]]:
        """Up to n segmentations of a text (with marks), best first: Viterbi forward, A* backward."""
        size, known = len(part), self.known
        into: list[list] = [[] for _ in range(size + 1)]
        best = [-math.inf] * (size + 1)
        best[0] = 0.0
        for i in range(size):
            here = best[i]
            for e in range(i + 1, min(size, i + self.longest) + 1):
                found = known.get(part[i:e])
                if found:
                    into[e].append((i, *found))
                    best[e] = max(best[e], here + found[1])
            if part[i] not in known:
                into[i + 1].append((i, -1, self.unknown))
                best[i + 1] = max(best[i + 1], here + self.unknown)
        out: list[tuple[float, list[int]]] = []
        # (distance from the best, order of coming, place, path from here to the end)
        queue: list[tuple] = [(0.0, 0, size, None)]
        count = 0
        while queue and len(out) < n:
            gap, _, at, path = heapq.heappop(queue)
            while at:  # the best way on from here costs nothing more: follow it, and queue the others
                score, on = best[at], None
                for i, piece, s in into[at]:
                    if on is None and best[i] + s == score:
                        on = (i, piece)
                    else:
                        count += 1
                        heapq.heappush(queue, (gap + (score - best[i] - s), count, i, (piece, path, i)))
                path, at = (on[1], path, on[0]), on[0]
            ids = []
            while path:
                piece, rest, i = path
                if piece >= 0:
                    ids.append(piece)
                else:
                    ids += [self.bytes.get(b, self.unk) for b in part[i].encode("utf-8", "surrogatepass")] if self.bytes else [self.unk]
                path = rest
            out.append((best[size] - gap, ids))
        return out

    def others(self, part: bytes, n: int) -> list[tuple[float, bytes]]:
        """The second to n-th best segmentations of a part: how far behind the best, ids."""
        key = (part, n)
        found = self.searches.get(key)
        if found is None:
            paths = self.search(part.decode("utf-8", "surrogatepass").replace(" ", MARK), n)
            found = [(paths[0][0] - s, _packed(ids)) for s, ids in paths[1:]]
            if len(part) <= SHORT:
                if len(self.searches) >= REMEMBER:
                    self.searches.clear()
                self.searches[key] = found
        return found

    def encode_all(self, texts: list[str | None], n: int = N) -> list[tuple[bytes, float, list[tuple[float, bytes]], bool]]:
        """For each text the ids and the score of its best segmentation, (score behind it, ids) of the next ones, and whether the ids decode to it."""
        marked = [(" " + t.replace(MARK, " ")).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        data = np.frombuffer(b"".join(marked), "uint8")
        out: list = [(b"", 0.0, [], True)] * len(texts)
        if not len(data):
            return out
        length = np.array([len(m) for m in marked])
        whole = np.cumsum(length) - length
        cut = np.r_[True, ~self.pairs[data[:-1], data[1:]]]
        cut[whole[length > 0]] = True
        starts = np.flatnonzero(cut)
        sizes = np.diff(np.r_[starts, len(data)])
        parts = np.searchsorted(starts, np.r_[whole, len(data)])

        place = np.arange(len(data)) - np.repeat(starts, sizes)
        hashes = np.add.reduceat(self._values()[data] * self._powers()[np.minimum(place, SHORT)], starts)
        short = sizes <= SHORT
        _, first, inverse = np.unique(hashes[short], return_index=True, return_inverse=True)
        first = np.flatnonzero(short)[first]
        counts, ids, scores, gaps = self.forward(data[spans(starts[first], sizes[first])], sizes[first])
        entry = np.empty(len(starts), "int64")
        entry[short] = inverse
        long = np.flatnonzero(~short)
        if len(long):  # such a part goes through the search at once
            more = [self.search(data[starts[k] : starts[k] + sizes[k]].tobytes().decode("utf-8", "surrogatepass").replace(" ", MARK), 2) for k in long.tolist()]
            entry[long] = len(counts) + np.arange(len(long))
            counts = np.r_[counts, [len(m[0][1]) for m in more]]
            ids = np.concatenate([ids, *[np.array(m[0][1], "int32") for m in more]])
            scores = np.r_[scores, [m[0][0] for m in more]]
            gaps = np.r_[gaps, [m[0][0] - m[1][0] if len(m) > 1 else np.inf for m in more]]

        own = counts[entry]
        tokens = ids[spans((np.cumsum(counts) - counts)[entry], own)]
        at = np.r_[0, np.cumsum(own)]
        raw = self.raw_size[tokens]
        decoded = self.raw[spans(self.raw_at[tokens], raw)]
        written = np.r_[0, np.cumsum(raw)][at[parts]]  # bytes that all documents before have become
        behind, part_scores = gaps[entry], scores[entry]
        for d in np.flatnonzero(length).tolist():
            a, b = int(parts[d]), int(parts[d + 1])
            same = bool(np.array_equal(decoded[written[d] : written[d + 1]], data[whole[d] : whole[d] + length[d]]))
            if not same and self.bytes:  # two parts of one hash: the text goes alone, part by part
                out[d] = self._alone(texts[d], n)
                continue
            few = behind[a:b]
            if n > 1 and b - a > n - 1:
                near = np.flatnonzero(few <= np.partition(few, n - 2)[n - 2])
                near = near[few[near].argsort(kind="stable")][: n - 1]
            else:
                near = few.argsort(kind="stable")[: n - 1]
            near = [k for k in near.tolist() if few[k] < math.inf]
            choices = [self.others(data[starts[a + k] : starts[a + k] + sizes[a + k]].tobytes(), n) for k in near]
            best = tokens[at[a] : at[b]].tobytes()
            places = [(4 * int(at[a + k] - at[a]), 4 * int(at[a + k + 1] - at[a])) for k in near]
            out[d] = (best, float(part_scores[a:b].sum()), merged(best, places, choices, n), same and MARK not in texts[d])
        return out

    def _alone(self, text: str, n: int) -> tuple[bytes, float, list[tuple[float, bytes]], bool]:
        paths = self.search(MARK + text.replace(" ", MARK), n)
        return _packed(paths[0][1]), paths[0][0], [(paths[0][0] - s, _packed(i)) for s, i in paths[1:]], MARK not in text and self.decode(paths[0][1]) == text

    def encode(self, text: str | None, n: int = N) -> tuple[bytes, float, list[tuple[float, bytes]]]:
        """The n best segmentations of a whole text: ids and score of the best, (score behind it, ids) of the others."""
        return self.encode_all([text], n)[0][:3]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        ids = np.asarray(ids, "int64")
        text = self.raw[spans(self.raw_at[ids], self.raw_size[ids])].tobytes().decode("utf-8", "surrogatepass")
        return text[1:] if text[:1] == " " else text

    @staticmethod
    def _values(held: list = []) -> np.ndarray:  # noqa: B006
        if not held:
            held.append(np.random.default_rng(7).integers(1 << 62, 1 << 63, 256).astype("uint64") * U(2) + U(1))
        return held[0]

    @staticmethod
    def _powers(held: list = []) -> np.ndarray:  # noqa: B006
        if not held:
            held.append(np.cumprod(np.r_[U(1), np.full(SHORT, _ODD)], dtype="uint64"))
        return held[0]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


def merged(best: bytes, places: list[tuple[int, int]], choices: list[list[tuple[float, bytes]]], n: int) -> list[tuple[float, bytes]]:
    """The second to n-th best ways to put other ids in place of some spans of the best ones. places: these spans, cheapest to leave first."""
    options = [(0.0, *[g for g, _ in c]) for c in choices]
    start = (0,) * len(places)
    queue, seen, chosen = [(0.0, start)], {start}, []
    while queue and len(chosen) < n:
        gap, pick = heapq.heappop(queue)
        chosen.append((gap, pick))
        for j in range(len(pick)):
            if pick[j] + 1 < len(options[j]):
                to = (*pick[:j], pick[j] + 1, *pick[j + 1 :])
                if to not in seen:
                    seen.add(to)
                    heapq.heappush(queue, (sum([o[x] for o, x in zip(options, to, strict=True)]), to))
    out = []
    for gap, pick in chosen[1:]:
        changed, since = [], 0
        for (a, b), ids in sorted((places[j], choices[j][k - 1][1]) for j, k in enumerate(pick) if k):
            changed += [best[since:a], ids]
            since = b
        out.append((gap, b"".join([*changed, best[since:]])))
    return out


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


SEGMENTS = "n_tokens long, ids_crc32 long, score double, segmentations array<struct<score: double, n_tokens: long, ids_crc32: long>>, round_trip boolean"


def segmented(docs: DataFrame, path: str, n: int = N, ids: bool = False) -> DataFrame:
    """doc_id, token count, checksum and score of the best segmentation, the n best, and with ids=True the best's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for whole in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(whole.column("text")), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < whole.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
                yield encode(model, whole.slice(at, to - at))
                at = to

    def encode(model: Pieces, b: pa.RecordBatch) -> pa.RecordBatch:
        rows = model.encode_all(b.column("text").to_pylist(), n)
        paths = [(score - g, len(i) // 4, zlib.crc32(i)) for i_, score, others, _ in rows for g, i in [(0.0, i_), *others]]
        bounds = np.cumsum([0, *[1 + len(r[2]) for r in rows]]).astype("int32")
        scores, counts, sums = (pa.array([p[k] for p in paths], kind) for k, kind in enumerate(("float64", "int64", "int64")))
        first = pa.array(bounds[:-1])
        lists = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([scores, counts, sums], names=["score", "n_tokens", "ids_crc32"]))
        columns = [b.column("doc_id"), counts.take(first), sums.take(first), scores.take(first), lists, pa.array([r[3] for r in rows], "bool")]
        names = ["doc_id", "n_tokens", "ids_crc32", "score", "segmentations", "round_trip"]
        if ids:
            flat = np.frombuffer(b"".join(r[0] for r in rows), "<i4")
            columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(r[0]) // 4 for r in rows]]).astype("int32")), pa.array(flat)))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, {SEGMENTS}" + ", ids array<int>" * ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmented(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model_path())

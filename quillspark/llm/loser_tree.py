"""Front coding of sorted strings, and their merge by a loser tree that knows common prefixes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, from start on."""
    end = min(len(a), len(b))
    if a[start:end] == b[start:end]:
        return end
    low, high = start, end  # the first difference lies in [low, high)
    while high - low > 8:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    while a[low] == b[low]:
        low += 1
    return low


def front_coded(strings: Sequence[bytes], lcps: Sequence[int]) -> bytes:
    """Each string as the length it shares with the one before (a byte), the length of its rest (a byte) and its rest."""
    return b"".join([x for s, n in zip(strings, lcps, strict=True) for x in (bytes((n, len(s) - n)), s[n:])])


def decoded(data: bytes) -> Iterator[tuple[bytes, int]]:
    """(string, prefix shared with the one before) of front-coded strings shorter than 256 bytes."""
    at, last = 0, b""
    while at < len(data):
        n, rest = data[at], data[at + 1]
        last = last[:n] + data[at + 2 : at + 2 + rest]
        at += 2 + rest
        yield last, n


def merge(runs: Sequence[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, bytes, int]]:
    """(run, string, prefix shared with the string before it in the output) of all runs in order; ties by run number.

    Every contender knows its common prefix with the last winner. Of two, the one with the longer prefix is less; only
    on equal prefixes are characters compared, from the end of the prefix on, so that no known prefix is read again.
    """
    k = len(runs)
    if not k:
        return
    size = 1
    while size < k:
        size *= 2
    strings: list[bytes | None] = [None] * size
    shared = [0] * size
    loser = [0] * size
    for i, r in enumerate(runs):
        first = next(r, None)
        if first:
            strings[i] = first[0]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix becomes the one with the winner."""
        x, y = strings[a], strings[b]
        if x is None or y is None:
            return (b, a) if x is None and y is not None else (a, b)
        p, q = shared[a], shared[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        n = common(x, y, p)
        less = n == len(x) if n == len(x) or n == len(y) else x[n] < y[n]
        if n == len(x) == len(y):
            less = a < b
        win, lose = (a, b) if less else (b, a)
        shared[lose] = n
        return win, lose

    def build(node: int) -> int:
        if node >= size:
            return node - size
        win, lose = play(build(2 * node), build(2 * node + 1))
        loser[node] = lose
        return win

    win = build(1) if size > 1 else 0
    while strings[win] is not None:
        yield win, strings[win], shared[win]
        following = next(runs[win], None)
        strings[win], shared[win] = following if following else (None, 0)
        node = (win + size) // 2
        while node:
            win, loser[node] = play(win, loser[node])
            node //= 2

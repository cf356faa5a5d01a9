"""Statistics of whole texts as built-in column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import SPACE, SPACES

#: Characters that count as symbols: fixed values.
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text in order; none of a null text."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(F.length(inner) == 0, F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def word_chars(text: Column) -> Column:
    return (F.coalesce(F.length(text), F.lit(0)) - count(text, r"[\x20\x09-\x0D]")).cast("long")


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside windows of `width` words that occur twice or more in the text, the first occurrence included.

    Windows are compared by 64-bit hashes. Texts without a repeat stop after array_distinct; others sort (hash, place).
    """

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"])
            flagged = F.filter(s, lambda e, j: F.coalesce((j > 0) & same(e, F.greatest(j, F.lit(1))), F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False)))
            return F.sort_array(F.transform(flagged, lambda e: e["i"]))

        steps = lambda p: F.transform(p, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - x, F.lit(width))))
        total = let(let(placed, places), lambda p: F.aggregate(steps(p), F.lit(0), lambda a, x: a + x))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(total)

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))
        return F.when(F.size(w) < width, F.lit(0)).otherwise(let(hashes, covered))

    return let(words, of).cast("long")

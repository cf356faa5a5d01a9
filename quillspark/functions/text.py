"""Scalar text functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
TOKEN = r"[a-z0-9_]+"
CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"
SENTENCE = r"""(?s).+?(?:(?:[。！？]+[”’」』）】]*)|(?:[.!?]+["'”’)\]]*(?=\s|$))|\n+|$)"""
CLAUSE = r"(?s).+?(?:(?:[，；：、]+)|(?:[,;:]+(?=\s|$))|$)"
MARKER = "\n...[truncated]...\n"
BLANK = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]"


def every(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def lexical_tokens(text: Column) -> Column:
    """Lower-case ASCII tokens, then for each CJK run its characters and its adjacent pairs; repeats stay."""
    text = F.coalesce(text, F.lit(""))

    def of(run: Column) -> Column:
        one = F.split(run, "")
        one = F.filter(one, lambda c: c != "")
        two = F.filter(F.transform(one, lambda c, i: F.concat(c, F.coalesce(F.get(one, i + 1), F.lit("")))), lambda p: F.length(p) == 2)
        return F.concat(one, two)

    # A CJK character takes three bytes, so a text needs two more bytes than characters to hold one.
    more = F.when(F.octet_length(text) - F.length(text) >= 2, F.flatten(F.transform(every(text, f"{CJK}+"), of))).otherwise(F.array().cast("array<string>"))
    return F.concat(every(F.lower(text), TOKEN), more)


def token_estimate(text: Column) -> Column:
    """CJK characters, and a quarter of the others rounded up."""
    cjk = F.coalesce(F.regexp_count(text, F.lit(CJK)), F.lit(0))
    return F.coalesce(cjk + F.ceil((F.length(text) - cjk) / 4), F.lit(0)).cast("long")


def trim_text(text: Column, limit: int, how: str = "middle", marker: str = MARKER) -> Column:
    """Stripped text of at most limit characters, cut at the end, the start or the middle; limit 0: no cut."""
    text = strip(F.coalesce(text, F.lit("")))
    if limit <= 0:
        return text
    if how == "head" or limit <= len(marker) + 2:
        cut = strip(F.substring(text, 1, limit))
    elif how == "tail":
        cut = strip(F.substring(text, -limit, limit))
    else:
        head = (limit - len(marker)) // 2
        tail = limit - len(marker) - head
        left = F.regexp_replace(F.substring(text, 1, head), f"{BLANK}+$", "")
        right = F.regexp_replace(F.substring(text, -tail, tail), f"^{BLANK}+", "")
        cut = strip(F.concat(left, F.lit(marker), right))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(every(text, SENTENCE), strip), lambda s: s != "")


def clauses(text: Column) -> Column:
    return F.filter(F.transform(every(text, CLAUSE), strip), lambda s: s != "")


def clean_title(title: Column, limit: int = 40) -> Column:
    flat = strip(F.regexp_replace(F.coalesce(title, F.lit("")), f"{BLANK}+", " "))
    return F.when(flat == "", "New chat").otherwise(F.regexp_replace(F.substring(flat, 1, limit), f"{BLANK}+$", ""))


def name_uuid(namespace_hex: str, name: Column) -> Column:
    """A version 5 UUID."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


#: The namespace of URLs: a fixed value.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def public_source(path: Column) -> Column:
    """Slashes forward; of an absolute path the last part."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(p.rlike(r"^(/|[A-Za-z]:/)"), F.element_at(F.split(p, "/"), -1)).otherwise(p)

"""Text functions: normalisation, distance limits, alignment, and small conversions."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC, which Spark lacks; null stays null."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(T.IntegerType())
def display_width(s: pd.Series) -> pd.Series:
    """Columns on a terminal: wide and full-width characters take two, combining marks none."""

    def width(x: str) -> int:
        return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in x)

    return s.map(width, na_action="ignore").astype("Int32")


def _translate(text: Column, table: Mapping[str, str]) -> Column:
    if not table:
        return text
    gone = [k for k, v in table.items() if not v]
    kept = [k for k, v in table.items() if v]
    return F.translate(text, "".join(kept + gone), "".join(table[k] for k in kept))


def normalise(
    text: Column,
    confusions: Mapping[str, str] | None = None,
    homoglyphs: Mapping[str, str] | None = None,
    symbols: str = "",
    long_mark: str = "ー",
    compose: bool = True,
) -> Column:
    """The form in which names are compared.

    In this order: NFKC (``compose``), removal of all Unicode white space and of ``symbols``, one pass of the confusion
    map, one pass of the homoglyph map (never chained within a map), and runs of the long-vowel mark become one.
    """
    out = nfkc(text) if compose else text
    out = F.regexp_replace(out, r"(?U)\s+", "")
    if symbols:
        out = _translate(out, {c: "" for c in symbols})
    out = _translate(out, confusions or {})
    out = _translate(out, homoglyphs or {})
    return F.regexp_replace(out, f"{long_mark}{{2,}}", long_mark)


def close_map(extra: Mapping[str, str], homoglyphs: Mapping[str, str]) -> dict[str, str]:
    """A confusion map whose sources and targets are also given in their homoglyph form."""
    out = dict(extra)
    for a, b in extra.items():
        out.setdefault(homoglyphs.get(a, a), homoglyphs.get(b, b))
    return {a: b for a, b in out.items() if a != b}


def allowed_distance(length: Column) -> Column:
    """The edit distance that still counts as a match for a name of that length: 0, 1, 2, at most 3."""
    # Results depend on them.
    return F.when(length <= 2, 0).when(length <= 5, 1).when(length <= 9, 2).otherwise(3)


def hiragana_to_katakana(text: Column) -> Column:
    hira = "".join(map(chr, range(0x3041, 0x3097)))
    return F.translate(text, hira, "".join(chr(ord(c) + 0x60) for c in hira))


def contains_kana_blind(text: Column, part: Column) -> Column:
    return F.contains(hiragana_to_katakana(text), hiragana_to_katakana(part))


def html_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def file_name(text: Column, limit: int = 80) -> Column:
    """A safe file name: reserved characters in their full-width form, no controls, bounded, no dot or space at the end."""
    reserved = '\\/:*?"<>|'
    out = F.translate(text, reserved, "".join(chr(ord(c) + 0xFEE0) for c in reserved))
    out = F.substring(F.regexp_replace(out, r"\p{Cntrl}", ""), 1, limit)
    return F.regexp_replace(out, r"[. ]+$", "")


def badge(text: Column) -> Column:
    """(count, limit) of a badge such as ``12 / 200``; null where it cannot be read."""
    pattern = r"^\s*(\d{1,4})\s*/\s*(\d{1,4})\s*$"
    n = F.regexp_extract(text, pattern, 1)
    return F.when(n != "", F.struct(n.cast("int").alias("count"), F.regexp_extract(text, pattern, 2).cast("int").alias("limit")))


def bracket_words(text: Column) -> Column:
    """The words of the last full-width angle bracket of a text."""
    return F.array_remove(F.split(F.regexp_extract(text, r"＜([^＞]*)＞[^＜]*$", 1), r"[/・、\s]+"), "")


def literal_runs(text: Column, least: int = 5) -> Column:
    """The runs of at least ``least`` kana or ideographs."""
    return F.regexp_extract_all(text, F.lit(rf"([ぁ-ヿ一-鿿]{{{least},}})"), F.lit(1))


OPS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType())]))


def align(a: str, b: str) -> list[tuple[str, str, str]]:
    """The edits between a read ``a`` and its truth ``b``, in order; equal pairs are left out.

    ``sub``: (a's, b's); ``ins``: the read has a character too many (a's, empty); ``del``: it lacks one (empty, b's). Of
    several shortest alignments the one found from the end by preferring a substitution, then an insertion.
    """
    n, m = len(a), len(b)
    cost = [list(range(m + 1))]
    for i in range(1, n + 1):
        row = [i]
        for j in range(1, m + 1):
            row.append(min(cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]), row[j - 1] + 1, cost[i - 1][j] + 1))
        cost.append(row)
    out, i, j = [], n, m
    while i or j:
        here = cost[i][j]
        if i and j and here == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            if a[i] != b[j]:
                out.append(("sub", a[i], b[j]))
        elif i and here == cost[i - 1][j] + 1:
            i -= 1
            out.append(("ins", a[i], ""))
        else:
            j -= 1
            out.append(("del", "", b[j]))
    return out[::-1]


@F.pandas_udf(OPS)
def edit_ops(a: pd.Series, b: pd.Series) -> pd.Series:
    """``align`` as a column; null if either side is."""
    return pd.Series([None if x is None or y is None else align(x, y) for x, y in zip(a, b)])

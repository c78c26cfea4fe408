"""Text cleaning as Column expressions. Built-in functions throughout; the two steps Spark has no function for
(character references and Unicode normal forms) are one Arrow function, ``decompose``."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import reduce
from html.entities import html5

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: fixed value: characters that normalisation deletes
INVISIBLE = "­​‌‍﻿  "
#: fixed value: the combining mark deleted after decomposition
DOT_BELOW = "̣"
#: fixed values: placeholders
URL, NUMBER, NAME = "$URL$", "$NUM$", "$NE$"

TEXTS = 64  # texts that a worker holds as Python strings

SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
NOT_SPACE = r"[^\t-\r\x1c-\x20\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squash(c: Column | str) -> Column:
    """Unicode white space to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(as_column(c), SPACE + "+", " "))


def _closed(s: str) -> str:
    """Character references that a semicolon ends, decoded; HTML takes some names without one, too."""
    return re.sub(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], s)


def _decompose(s: str | None, closed: bool = False) -> str | None:
    if s is None:
        return None
    s = re.sub(r"<[^>]+>", " ", _closed(s) if closed else html.unescape(s))
    s = unicodedata.normalize("NFKD", s).replace(DOT_BELOW, "")
    return unicodedata.normalize("NFC", s.translate({ord(c): None for c in INVISIBLE}).replace(" ", " "))


def _decomposed(texts: pa.Array, closed: bool = False) -> pa.Array:
    """A batch, a few texts at a time: beside its two Arrow columns a worker holds no more than those as Python strings."""
    parts = [pa.array([_decompose(x, closed) for x in texts.slice(at, TEXTS).to_pylist()], pa.string()) for at in range(0, len(texts), TEXTS)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(StringType())
def decompose_arrow(texts: pa.Array) -> pa.Array:
    return _decomposed(texts)


@F.arrow_udf(StringType())
def decompose_closed_arrow(texts: pa.Array) -> pa.Array:
    return _decomposed(texts, True)


def _outside(f, c: Column) -> Column:
    """``f`` in Python, for the texts that need it: one of ASCII characters without ``&`` has no references and no other form, so
    only its tags go, and it stays in the JVM."""
    plain = (F.octet_length(c) == F.length(c)) & ~F.contains(c, F.lit("&"))
    return F.when(plain, F.regexp_replace(c, "<[^>]+>", " ")).otherwise(f(F.when(~plain, c)))


def decompose(c: Column | str) -> Column:
    """Character references decoded, tags to blanks, compatibility forms resolved, invisible characters dropped."""
    return _outside(decompose_arrow, as_column(c))


def decompose_closed(c: Column | str) -> Column:
    """The same, but a reference without its semicolon stays as it is: in a cut text it may be the beginning of another word."""
    return _outside(decompose_closed_arrow, as_column(c))


def placeholders(c: Column | str) -> Column:
    """Addresses and numbers to placeholders, white space squashed."""
    c = F.regexp_replace(as_column(c), rf"https?://{NOT_SPACE}+|www\.{NOT_SPACE}+", r"\$URL\$")
    return squash(F.regexp_replace(c, r"\p{Nd}+", r"\$NUM\$"))


def normalize(c: Column | str, closed: bool = False) -> Column:
    """The corpus's normal form. ``closed``: only character references that a semicolon ends are decoded."""
    return placeholders((decompose_closed if closed else decompose)(c))


def utf16_length(c: Column | str) -> Column:
    """Length in UTF-16 units."""
    return F.floor(F.octet_length(F.encode(as_column(c), "UTF-16BE")) / 2)


def utf16_left(c: Column | str, n: int) -> Column:
    """The first n UTF-16 units. Where the cut halves a character, a private one (U+E000) stands for the half."""
    c = as_column(c)
    units = F.left(F.hex(F.encode(F.left(c, F.lit(n)), "UTF-16BE")), F.lit(4 * n))  # n code points are n units at least

    def whole(u: Column) -> Column:
        return F.when(F.right(u, F.lit(4)).between("D800", "DBFF"), F.concat(F.left(u, F.length(u) - 4), F.lit("E000"))).otherwise(u)

    one = F.element_at(F.transform(F.array(units), whole), 1)  # the units are computed once
    return F.when(c.rlike(r"[\x{10000}-\x{10FFFF}]"), F.decode(F.unhex(one), "UTF-16BE")).otherwise(F.left(c, F.lit(n)))


def has_letter(c: Column | str) -> Column:
    return F.coalesce(as_column(c).rlike(r"\p{L}"), F.lit(False))


def strip_signature(c: Column | str) -> Column:
    """A trailing editorial signature such as (abc/def) goes."""
    return F.trim(F.regexp_replace(as_column(c), r"\s*\([a-z]+(?:/[a-z]+)+\)\s*$", ""))


def strip_exercise_labels(c: Column | str) -> Column:
    """``a) `` and, where digits are still there, ``1) `` and ``2a) ``."""
    return F.regexp_replace(as_column(c), r"(?:^| )(?:\p{Nd}+[a-z]?|[a-z])\) ", " ")


def strip_blanks(c: Column | str) -> Column:
    """Gaps to fill in: underscores and dots."""
    return F.trim(F.regexp_replace(as_column(c), r"_{2,}|\.{3,}", ""))


def textbook(c: Column | str) -> Column:
    return strip_blanks(F.trim(strip_exercise_labels(normalize(c))))


def strip_markup(c: Column | str) -> Column:
    """Transcript markup: tags and three entities."""
    c = F.regexp_replace(as_column(c), "<[^>]+>", " ")
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"')), c)


def sentences(c: Column | str) -> Column:
    """Array of sentences: parted at white space after . ! or ?"""
    return F.split(as_column(c), rf"(?<=[.!?]){SPACE}+")


def clean_for_training(c: Column | str) -> Column:
    """Lower-case words: no placeholders, no punctuation but inner hyphens and apostrophes."""
    c = F.regexp_replace(as_column(c), r"\$(?:NE|NUM|URL)\$", " ")
    c = F.regexp_replace(c, r"[^\p{L}\p{N}_ \-']", " ")
    c = F.regexp_replace(c, rf"(?<!{NOT_SPACE})-|-(?!{NOT_SPACE})", " ")
    return squash(F.lower(c))


def tokens(c: Column | str) -> Column:
    """Words between white space; none of a null or blank text."""
    return F.coalesce(F.filter(F.split(as_column(c), SPACE + "+"), lambda x: x != ""), F.array().cast("array<string>"))


def letter_tokens(c: Column | str, least: int = 2) -> Column:
    """Runs of letters, inner apostrophes kept, of ``least`` characters or more."""
    found = F.regexp_extract_all(as_column(c), F.lit(r"(\p{L}+(?:'\p{L}+)*)"), 1)
    return F.coalesce(F.filter(found, lambda x: F.length(x) >= least), F.array().cast("array<string>"))


def mask(c: Column | str, terms: list[str] | tuple[str, ...]) -> Column:
    """Each term in turn, wherever it stands, to the name placeholder; the order matters."""
    return reduce(lambda x, t: F.replace(x, F.lit(t), F.lit(NAME)), terms, as_column(c))


def share_of(c: Column | str, marks: list[str] | tuple[str, ...]) -> Column:
    """Per cent of characters that go when the marks are deleted one after another."""
    c = as_column(c)
    left = reduce(lambda x, t: F.replace(x, F.lit(t), F.lit("")), marks, c)
    return F.when(F.length(c) > 0, (F.length(c) - F.length(left)) / (F.length(c) / F.lit(100.0))).otherwise(F.lit(0.0))


def average(total: Column, n: Column) -> Column:
    """One decimal, 0 without rows."""
    return F.when(n > 0, F.round(total / n, 1)).otherwise(F.lit(0.0))


def delta(a: Column, b: Column, least: float = 0.001) -> Column:
    """A signed difference as text, with a sign for about equal."""
    d = b - a
    return F.when(F.abs(d) < least, F.lit("≈")).otherwise(F.concat(F.when(d > 0, F.lit("+")).otherwise(F.lit("")), F.format_number(d, 3)))


def escaped(c: Column | str) -> Column:
    """Text that may stand in HTML."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")), as_column(c))


def thousands(c: Column | str) -> Column:
    """A whole number with commas."""
    return F.format_number(as_column(c), 0)


def excerpt(c: Column | str, term: Column | str, around: int = 70) -> Column:
    """The text around the first place of ``term``, with an ellipsis where it was cut."""
    c, t = as_column(c), term if isinstance(term, Column) else F.lit(term)
    at = F.position(t, c)
    a = F.greatest(at - around, F.lit(1))
    b = F.least(at + F.length(t) - 1 + around, F.length(c))
    cut = F.substr(c, a, b - a + 1)
    return F.when(at > 0, F.concat(F.when(a > 1, F.lit("…")).otherwise(F.lit("")), cut, F.when(b < F.length(c), F.lit("…")).otherwise(F.lit(""))))


@F.pandas_udf(StructType([StructField("category", StringType()), StructField("name", StringType())]))
def character(s: pd.Series) -> pd.DataFrame:
    """Unicode category and name of single characters."""
    return pd.DataFrame({"category": [unicodedata.category(x) if isinstance(x, str) and len(x) == 1 else None for x in s], "name": [unicodedata.name(x, "") if isinstance(x, str) and len(x) == 1 else None for x in s]})

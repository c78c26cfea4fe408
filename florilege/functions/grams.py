"""Character and word n-grams as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from florilege.functions.text import WORD, as_column, tokens


def _windows(token: Column, n: int) -> Column:
    """All substrings of length n; none of a shorter token."""
    at = F.when(F.length(token) >= n, F.sequence(F.lit(1), F.length(token) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.substr(token, i, F.lit(n)))


def bound(c: Column, f) -> Column:
    """f(c) with c computed once: inside a lambda an expression would be computed for every element."""
    return F.element_at(F.transform(F.array(c), f), 1)


def _sized(n: int):
    return lambda t: _windows(t, n)


def words(c: Column | str) -> Column:
    """Lower-case runs of two or more word characters."""
    found = F.regexp_extract_all(F.lower(as_column(c)), F.lit(rf"({WORD}{{2,}})"), 1)
    return F.coalesce(found, F.array().cast("array<string>"))


def char_grams(c: Column | str, low: int, high: int) -> Column:
    """n-grams inside words, each word padded by a blank on either side."""
    padded = F.transform(words(c), lambda t: F.concat(F.lit(" "), t, F.lit(" ")))
    return bound(padded, lambda p: F.flatten(F.concat(*(F.transform(p, _sized(n)) for n in range(low, high + 1)))))


def word_char_grams(word: Column | str, low: int, high: int) -> Column:
    """The n-grams of one word, padded by a blank on either side."""
    padded = F.concat(F.lit(" "), as_column(word), F.lit(" "))
    return F.concat(*(_windows(padded, n) for n in range(low, high + 1)))


def char_grams_wb(c: Column | str, low: int, high: int) -> Column:
    """n-grams inside white-space words with their punctuation; a word no longer than n yields itself once, at the
    first such n, and nothing for larger n."""
    padded = F.transform(tokens(F.lower(as_column(c))), lambda t: F.concat(F.lit(" "), t, F.lit(" ")))

    def of(t: Column) -> Column:
        parts = []
        for n in range(low, high + 1):
            short = F.when((F.length(t) <= n) & (F.lit(n == low) | (F.length(t) > n - 1)), F.array(t)).otherwise(F.array().cast("array<string>"))
            parts.append(F.when(F.length(t) > n, _windows(t, n)).otherwise(short))
        return F.flatten(F.array(*parts))

    return F.flatten(F.transform(padded, of))


def word_grams(c: Column | str, low: int, high: int) -> Column:
    """Runs of n words, joined by blanks."""
    def of(w: Column, n: int) -> Column:
        at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))

    return bound(words(c), lambda w: F.concat(*(of(w, n) for n in range(low, high + 1))))


def trigram_text(c: Column | str) -> Column:
    """The text without ASCII digits and punctuation, in lower case, a blank at either end: what trigrams are cut from. White space is that of
    RE2, without the vertical tab; a character has one small letter wherever it stands (no dot beside an i, no other sigma at a word's end)."""
    one = F.replace(F.replace(F.regexp_replace(F.regexp_replace(as_column(c), r"[!-@]+", " "), r"[\t\n\f\r ]+", " "), F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ"))
    return F.concat(F.lit(" "), F.lower(F.trim(one)), F.lit(" "))


def trigrams(c: Column | str) -> Column:
    """Trigrams of ``trigram_text`` as an array."""
    return bound(F.split(trigram_text(c), ""), _threes)


def _threes(x: Column) -> Column:
    """Three neighbours each of an array of characters. Places in an array are found at once, those in a UTF-8 string by
    walking it, so a long text costs what its length says."""
    at = F.when(F.size(x) >= 3, F.sequence(F.lit(0), F.size(x) - 3)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat(F.get(x, i), F.get(x, i + 1), F.get(x, i + 2)))

"""Trigrams of whole texts, counted where the texts lie.

A text comes from the JVM as ``grams.trigram_text`` leaves it; a task holds a trigram as one number of three code points and counts by
sorting. What is shuffled are a task's sums (``totals``) or nothing at all (``known``), never a row per trigram of a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from florilege.functions import grams

CHARS = 1 << 19  # characters that are counted together
KINDS = 400_000  # distinct trigrams that a task remembers before it hands its sums on
_CODE = (1 << 21) - 1


def number(trigram: str) -> int:
    a, b, c = map(ord, trigram)
    return a << 42 | b << 21 | c


def string(n: int) -> str:
    return chr(n >> 42) + chr(n >> 21 & _CODE) + chr(n & _CODE)


def cut(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and numbers of all trigrams, about ``CHARS`` at a time, rows ascending; null has none. A longer text comes in pieces."""
    held, rows, n = [], [], 0

    def out() -> tuple[np.ndarray, np.ndarray]:
        code = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        row = np.repeat(np.array(rows, np.int64), [len(x) for x in held])
        piece = np.repeat(np.arange(len(held)), [len(x) for x in held])
        ok = piece[2:] == piece[:-2]
        return row[2:][ok], (code[:-2] << 42 | code[1:-1] << 21 | code[2:])[ok]

    for i, value in enumerate(texts):
        text = value.as_py() or ""
        for at in range(0, max(1, len(text) - 2), CHARS):
            part = text[at : at + CHARS + 2]
            held.append(part)
            rows.append(i)
            n += len(part)
            if n >= CHARS:
                yield out()
                held, rows, n = [], [], 0
    if held:
        yield out()


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(key, return_inverse=True)
    return key, np.bincount(at, n, len(key)).astype(np.int64)


def totals(df: DataFrame, group_col: str, text_col: str = "text") -> DataFrame:
    """``lang, trigram, n``: how often each trigram stands in the texts of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}

        def out() -> Iterator[pa.RecordBatch]:
            for g, (key, n) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(key), kind), pa.array([string(k) for k in key.tolist()], pa.string()), pa.array(n)], ["lang", "trigram", "n"])
            sums.clear()

        for batch in batches:
            kind = batch.column(0).type
            code = batch.column(0).dictionary_encode(null_encoding="encode")
            names, mine = code.dictionary.to_pylist(), code.indices.to_numpy()
            for row, key in cut(batch.column(1)):
                group = mine[row]
                for g in np.unique(group).tolist():
                    k, n = np.unique(key[group == g], return_counts=True)
                    if names[g] in sums:
                        old = sums[names[g]]
                        k, n = _summed(np.concatenate((old[0], k)), np.concatenate((old[1], n)))
                    sums[names[g]] = k, n
                if sum(len(k) for k, _ in sums.values()) > KINDS:
                    yield from out()
        yield from out()

    each = df.select(F.col(group_col).alias("lang"), grams.trigram_text(text_col).alias("t"))
    sums = each.mapInArrow(run, StructType([each.schema["lang"], *StructType.fromDDL("trigram string, n long").fields]))
    return sums.groupBy("lang", "trigram").agg(F.sum("n").alias("n"))


def known(read: DataFrame, profiles: list[list[tuple[str, int]]], missing: int, text_col: str = "text") -> DataFrame:
    """``read`` with ``kinds``, a text's distinct trigrams, and ``less``, for each profile (trigram and rank) the sum of |count - rank - 1| -
    ``missing`` over those of the text's trigrams that it has, in place of ``text_col``; texts without a trigram give no row."""
    rest = [c for c in read.columns if c != text_col]
    flat = sorted({(number(t), j, r, i) for j, p in enumerate(profiles) for i, (t, r) in enumerate(p) if len(t) == 3})
    sent = read.sparkSession.sparkContext.broadcast(tuple(np.array([x[i] for x in flat], np.int64) for i in range(3)))  # bounded: top rows per language
    width = len(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry, lang, rank = sent.value
        for batch in batches:
            kinds, less = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, width), np.int64)

            def add(row: np.ndarray, key: np.ndarray, n: np.ndarray) -> None:
                nonlocal kinds
                kinds += np.bincount(row, minlength=len(kinds))
                lo, hi = np.searchsorted(entry, key, "left"), np.searchsorted(entry, key, "right")
                many = hi - lo
                at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                np.add.at(less, (np.repeat(row, many), lang[at]), np.abs(np.repeat(n, many) - rank[at] - 1) - missing)

            held: tuple = (np.zeros(0, np.int64),) * 3  # of the last row, whose text may go on
            for row, key in cut(batch.column(0)):
                word, code = np.unique(key, return_inverse=True)
                pair, n = np.unique(row * max(1, len(word)) + code, return_counts=True)
                row, key = pair // max(1, len(word)), word[pair % max(1, len(word))]
                if len(held[0]) and len(row) and held[0][0] == row[0]:
                    same = row == row[0]
                    k, m = _summed(np.concatenate((held[1], key[same])), np.concatenate((held[2], n[same])))
                    row, key, n = np.concatenate((np.full(len(k), row[0]), row[~same])), np.concatenate((k, key[~same])), np.concatenate((m, n[~same]))
                else:
                    add(*held)
                last = row == row[-1] if len(row) else np.zeros(0, bool)
                add(row[~last], key[~last], n[~last])
                held = row[last], key[last], n[last]
            add(*held)
            some = pa.array(np.flatnonzero(kinds))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(less.ravel()), width).cast(pa.list_(pa.int64())) if width else pa.array([[]] * batch.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(some) for i in range(1, batch.num_columns)), pa.array(kinds).take(some), lists.take(some)], [*rest, "kinds", "less"])

    each = read.select(grams.trigram_text(text_col).alias("_t"), *rest)
    return each.mapInArrow(run, StructType([*(each.schema[c] for c in rest), *StructType.fromDDL("kinds long, less array<long>").fields]))

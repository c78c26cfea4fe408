"""Benchmark decontamination: which words of a document lie inside a benchmark passage.

Method: one Aho-Corasick automaton over all windows of the normalised benchmark items; each text
is normalised, scanned once, and hits are mapped back to word numbers and to offsets in the
original text. The automaton reads words as numbers of the benchmark's words; it is shipped as the items themselves and
built once in a worker, which keeps it for its later tasks. Its size is
checked: items beyond ``budget`` bytes are dealt to several automata, applied one after another.

Edge cases: null and empty texts have no words and no hits; an item without words matches nothing,
an item of fewer than ``window`` words is one window; repeated rows, repeated items and null ids are kept; a very long text is
scanned in one piece, its words as one string; ties don't arise (every window counts); an empty table gives an empty result;
other columns, whatever their names, stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.llm import core
from florilege.session import stage

WINDOW = 10
BUDGET = 2 << 20  # bytes of benchmark text in one automaton: some 350,000 words, 3.5 million nodes
#: A-Z to lower case; digits, letters and all bytes of other scripts stay; the rest separates words
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 0x20 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def item_windows(text: bytes, window: int) -> set[bytes]:
    w = words(text)
    return {b" ".join(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else set()


class Scanner:
    """One automaton over all windows, in numbers of benchmark words: a window is ten characters then, not sixty bytes, so a
    node stands for a word. A hit tells its words and its items."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        import ahocorasick

        self.number: dict[bytes, str] = {}
        found: dict[str, list] = {}
        for item, text in items:
            for w in item_windows((text or "").encode(), window):
                key = "".join(self.number.setdefault(x, _character(len(self.number))) for x in w.split(b" "))
                found.setdefault(key, []).append(item)
        self.trie = None
        if found:
            self.trie = ahocorasick.Automaton()
            for key, who in found.items():
                self.trie.add_word(key, (len(key), who))
            self.trie.make_automaton()

    def hits(self, text: list[bytes]) -> list[tuple[int, tuple[int, list]]]:
        """(last word, (words, items)) of each window in a text."""
        if self.trie is None or not text:
            return []
        return list(self.trie.iter("".join(map(self.number.get, text, repeat(OTHER)))))


OTHER = chr(1)  # a word that no item has
_scanners: dict[tuple, Scanner] = {}


def _character(k: int) -> str:
    """The k-th word's character; more words than characters can't fit into the budget of one automaton."""
    k += 2
    return chr(k if k < 0xD800 else k + 0x800)


def scanner(key: tuple, items: list, window: int) -> Scanner:
    """Built once in a worker, kept for its later tasks."""
    if key not in _scanners:
        while len(_scanners) >= 2:
            _scanners.pop(next(iter(_scanners)))
        _scanners[key] = Scanner(items, window)
    return _scanners[key]


def original_spans(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as code-point ranges of the original text."""
    raw = np.frombuffer(text.translate(NORMAL), np.uint8)
    starts, ends = core.words_of(raw)
    lead = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [(int(lead[starts[a]]), int(lead[ends[b - 1]])) for a, b in spans]


def _scan(shared, key: str, window: int, kind: str, item_kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core.occupy("decontamination", _scanners.clear)
        trie = scanner((key, window), shared.value, window)
        for b in batches:
            raw, off = core.utf8(b.column(1))
            counts, spans, who = [], [], []
            for i in range(len(off) - 1):
                w = words(raw[off[i] : off[i + 1]].tobytes())
                counts.append(len(w))
                mine = b.column(3)[i].as_py() or []
                covered = [(x["a"], x["b"]) for x in b.column(2)[i].as_py() or []]
                hits = trie.hits(w)
                if hits:
                    covered += [(e + 1 - n, e + 1) for e, (n, _) in hits]
                    mine = mine + [x for _, (_, ids) in hits for x in ids]
                merged: list[list[int]] = []
                for x, y in sorted(covered):
                    if merged and x <= merged[-1][1]:
                        merged[-1][1] = max(y, merged[-1][1])
                    else:
                        merged.append([x, y])
                spans.append([{"a": x, "b": y} for x, y in merged])
                who.append(sorted(set(mine), key=lambda x: (x is None, str(x))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(who, b.column(3).type), pa.array(counts, pa.int64())], ["_id", "_t", "spans", "items", "n_words"])

    return run, f"_id {kind}, _t string, spans array<struct<a:long,b:long>>, items array<{item_kind}>, n_words long"


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, budget: int = BUDGET) -> DataFrame:
    """One row per document: ``id_col, _t`` (its text), ``n_words``, ``spans`` (hit word ranges, maximal, end
    excluded) and ``items`` (ids with an occurring window, sorted as strings)."""
    base = core.documents(docs, id_col, text_col)
    items = benchmark.select(F.col(item_col).alias("_id"), F.col(item_text).cast("string").alias("_t"))
    kind, item_kind = core.id_type(base), core.id_type(items)
    size = items.agg(F.sum(F.octet_length("_t"))).first()[0] or 0
    chunks = max(1, -(-size // budget))
    out = base.select("_id", "_t", F.lit(None).cast("array<struct<a:long,b:long>>").alias("spans"), F.lit(None).cast(f"array<{item_kind}>").alias("items"))
    for k in range(chunks):
        part = items.where(F.pmod(F.xxhash64("_id", "_t"), F.lit(chunks)) == k) if chunks > 1 else items
        rows = [(r[0], r[1]) for r in part.collect()]
        shared = docs.sparkSession.sparkContext.broadcast(rows)  # at most ``budget`` bytes of text
        out = out.select("_id", "_t", "spans", "items").mapInArrow(*_scan(shared, uuid.uuid4().hex, window, kind, item_kind))
        out = stage(out, "decontaminate") if k + 1 < chunks else out
    return out.withColumnRenamed("_id", id_col)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, budget: int = BUDGET) -> DataFrame:
    """``docs`` without the documents in which any window of the benchmark occurs; all columns stay."""
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)), F.lit(0).alias("_0")).alias("_row"), F.col(f"`{text_col}`").cast("string").alias("_text"), F.col(f"`{text_col}`").isNull().alias("_null"))
    rows = rows.select(F.struct("_row", "_null").alias("_row"), "_text")
    got = contamination(rows, benchmark, "_row", "_text", item_col, item_text, window, budget).where(F.size("spans") == 0)
    cols = {text_col: F.when(~F.col("_row._null"), F.col("_t")).cast(docs.schema[text_col].dataType).alias(text_col)} | {c: F.col(f"_row._row.c{i}").alias(c) for i, c in enumerate(rest)}
    return got.select(*(cols[c] for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    got = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return got.select(
        "doc_id", "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["b"] - s["a"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


ORACLE = """
WITH lo AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
it AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS g
       FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM it WHERE len(ws) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM lo, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
hit AS (SELECT doc_id, n, i, item_id FROM dw JOIN iw USING (n, g)),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, range(0, 10) t(k) WHERE k < n GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM lo LEFT JOIN cov USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

"""Line dedup by pairwise alignment.

Method: a document is aligned with earlier documents (smaller id) that share its lines. The first
document holding a line is the line's owner; a document's rare lines lead to its owners, and the owner
that most of them lead to is compared line by line. Two lines in a row are looked up like a line, too:
the first document that has them in a row is compared there, so a common block of two lines or more is met
whole even if its lines were first seen in different documents. Matched lines of a pair are put in order by patience
diff (the longest increasing run of positions; the k-th copy of a line in one text matches the k-th
in the other, so every line is unique). Stretches of matched lines adjacent in both texts are common
blocks. A block is deleted from the later document if it holds at least ``least_lines`` lines, a line of at
least ``long_words`` words (in however many documents), or a rare line; a short single line that is common all
over the corpus is no evidence of overlap and stays. Each line and each two lines in a row
meet their owner only, never all other holders, so the work is linear in lines.

Lines are compared without white space at their ends; blank lines match nothing and don't part a
block. Rare: in at most ``rare`` documents and of at least ``least_words`` words. A document all of whose
lines are deleted gets an empty text.

Edge cases: null texts stay null; the first of repeated rows can't be told from the others (same id and
text), so repeated rows keep their lines; null ids come before all others; other columns, whatever their names, pass
through. Of equally good partners or runs the choice is fixed by their keys (ties). A very long text is split to lines in
one piece, in a few arrays of its size. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from florilege.llm import core
from florilege.session import stage

RARE = 50
LEAST_WORDS = 5
LEAST_LINES = 2
LONG_WORDS = 7


def split_lines(text: bytes) -> list[bytes]:
    return text.split(b"\n")


def copies(doc: np.ndarray, code: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """How many equal codes precede each one in its text."""
    order = np.lexsort((pos, code, doc))
    new = np.ones(len(order), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (code[order][1:] != code[order][:-1])
    start = np.flatnonzero(new)
    k = np.empty(len(order), np.int64)
    k[order] = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return k


def line_rows(raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Non-blank lines of each text: doc, pos, code of the stripped line, how many equal ones precede it in its text,
    words; code and copies of the two lines in a row that begin there (``last``: none do)."""
    size = np.diff(off)
    joint = np.full(int(size.sum()) + len(size), 0x0A, np.uint8)
    end = np.cumsum(size + 1) - 1
    take = np.ones(len(joint), bool)
    take[end] = False
    joint[take] = raw[off[0] : off[-1]]
    le = np.flatnonzero(joint == 0x0A)
    ls = np.concatenate(([0], le[:-1] + 1))
    ws, we = core.words_of(joint)
    a, b = np.searchsorted(ws, ls), np.searchsorted(ws, le)
    full = b > a
    doc = np.searchsorted(end, ls)
    first = np.searchsorted(ls, np.concatenate(([0], end[:-1] + 1)))
    pos = np.arange(len(ls)) - first[doc]
    doc, pos, a, b = doc[full], pos[full], a[full], b[full]
    lo, hi = ws[a], we[b - 1]
    code = core.mix(core.between(core.prefix(core.BYTE_CODE[joint]), lo, hi) ^ core.mix((hi - lo).astype(np.uint64)))
    last = np.ones(len(doc), bool)
    last[:-1] = doc[1:] != doc[:-1]
    two = core.mix(code * core.BASE + np.append(code[1:], core.U(0)))[~last]
    pair, pk = np.zeros(len(doc), np.uint64), np.zeros(len(doc), np.int64)
    pair[~last], pk[~last] = two, copies(doc[~last], two, pos[~last])
    return {"doc": doc, "pos": pos, "code": code, "k": copies(doc, code, pos), "words": b - a, "pair": pair, "pk": pk, "last": last}


def _lines(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core.occupy("lines")
        for b in batches:
            raw, off = core.utf8(b.column(1))
            at, n = 0, len(off) - 1
            while at < n:
                to = max(at + 1, int(np.searchsorted(off, off[at] + core.BLOCK, "right")) - 1)
                r = line_rows(raw, off[at : to + 1])
                who = pa.array(r["doc"] + at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(who), b.column(2).take(who), pa.array(r["pos"].astype(np.int32)), pa.array(r["code"].view(np.int64)), pa.array(r["k"].astype(np.int32)), pa.array(r["words"].astype(np.int32)), pa.array(r["pair"].view(np.int64), mask=r["last"]), pa.array(r["pk"].astype(np.int32))], ["_id", "_h", "pos", "code", "k", "words", "pair", "pk"])
                at = to

    return run, f"_id {kind}, _h long, pos int, code long, k int, words int, pair long, pk int"


def patience(pairs: list[tuple[int, int]]) -> list[int]:
    """Indices of a longest run that rises in both members; pairs ascend in the first."""
    tops: list[int] = []
    pile: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(pairs):
        j = bisect_left(tops, y)
        back.append(pile[j - 1] if j else -1)
        if j == len(tops):
            tops.append(y)
            pile.append(i)
        else:
            tops[j] = y
            pile[j] = i
    out = []
    i = pile[-1] if pile else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def deleted(matches: dict, inked: list[int], least_lines: int) -> set[int]:
    """Positions to delete: ``matches`` holds for each earlier document (position, its position, whether the line
    is evidence by itself) of matched lines, positions counted over non-blank lines on both sides; ``inked`` maps back."""
    gone: set[int] = set()
    for rows in matches.values():
        alone: dict[tuple[int, int], bool] = {}
        for a, b, x in rows:
            alone[a, b] = alone.get((a, b), False) or x
        rows = [(a, b, alone[a, b]) for a, b in sorted(alone, key=lambda x: (x[0], -x[1]))]  # so a line is taken once
        keep = [rows[i] for i in patience([(a, b) for a, b, _ in rows])]
        block: list[tuple[int, int, bool]] = []
        for r in [*keep, None]:
            if block and (r is None or r[0] != block[-1][0] + 1 or r[1] != block[-1][1] + 1):
                if len(block) >= least_lines or any(x[2] for x in block):
                    gone.update(inked[x[0]] for x in block)
                block = []
            if r is not None:
                block.append(r)
    return gone


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE, least_words: int = LEAST_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """Matched lines of each document: ``_id, _h, matches`` array of (pos, oid, oh, opos, alone); positions count
    non-blank lines, ``alone`` lines are evidence by themselves: rare or long."""
    base = core.documents(docs, id_col, text_col)
    rows = base.select("_id", "_t", "_h").mapInArrow(*_lines(core.id_type(base)))
    rows = stage(rows.dropDuplicates(["_id", "_h", "pos"]).withColumn("pos", (F.row_number().over(W.partitionBy("_id", "_h").orderBy("pos")) - 1).cast("int")), "lines")
    # the owner of each line; counting and choosing are map-side, so a line of a third of all texts is as cheap as any
    owner = stage(rows.groupBy("code", "k").agg(F.min(F.struct("_id", "_h", "pos")).alias("o"), F.count(F.lit(1)).alias("df")).where("df > 1"), "line-owners")
    met = rows.alias("r").join(owner.alias("w"), ["code", "k"]).select("code", "k", "r._id", "r._h", "r.pos", F.col("o._id").alias("oid"), F.col("o._h").alias("oh"), F.col("o.pos").alias("opos"), ((F.col("df") <= rare) & (F.col("words") >= least_words)).alias("rare"), (F.col("words") >= long_words).alias("long"))
    met = stage(met.withColumn("alone", F.col("rare") | F.col("long")).drop("long").where(~(F.col("_id").eqNullSafe(F.col("oid")) & (F.col("_h") == F.col("oh")))), "line-matches")
    # the earlier document most of a text's lines lead to, rare ones first: its other lines are looked up, too
    votes = met.groupBy("_id", "_h", "oid", "oh").agg(F.sum(F.col("rare").cast("long")).alias("v"), F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("_id", "_h").agg(F.max(F.struct(F.col("v"), F.col("n"), F.struct(F.col("oid"), F.col("oh")).alias("o"))).alias("b")).select("_id", "_h", "b.o.oid", "b.o.oh")
    best = stage(best, "line-partners")
    asked = met.alias("m").join(best.alias("b"), F.col("m._id").eqNullSafe(F.col("b._id")) & (F.col("m._h") == F.col("b._h"))).where(~(F.col("m.oid").eqNullSafe(F.col("b.oid")) & (F.col("m.oh") == F.col("b.oh")))).select("m._id", "m._h", "m.pos", "m.code", "m.k", "m.alone", F.col("b.oid").alias("oid"), F.col("b.oh").alias("oh"))
    asked = stage(asked, "line-lookups")
    more = asked.alias("a").join(rows.alias("r"), F.col("a.oid").eqNullSafe(F.col("r._id")) & (F.col("a.oh") == F.col("r._h")) & (F.col("a.code") == F.col("r.code")) & (F.col("a.k") == F.col("r.k"))).select("a._id", "a._h", "a.pos", "a.oid", "a.oh", F.col("r.pos").alias("opos"), "a.alone")
    both = met.select("_id", "_h", "pos", "oid", "oh", "opos", "alone").unionByName(more)
    # the owner of each two lines in a row: it holds them in a row, whatever documents had either line before
    twos = rows.where("pair IS NOT NULL").select("pair", "pk", "_id", "_h", "pos")
    first = stage(twos.groupBy("pair", "pk").agg(F.min(F.struct("_id", "_h", "pos")).alias("o"), F.count(F.lit(1)).alias("df")).where("df > 1").select("pair", "pk", "o"), "line-pair-owners")
    held = twos.alias("r").join(first.alias("w"), ["pair", "pk"]).select("r._id", "r._h", "r.pos", F.col("o._id").alias("oid"), F.col("o._h").alias("oh"), F.col("o.pos").alias("opos"))
    held = held.where(~(F.col("_id").eqNullSafe(F.col("oid")) & (F.col("_h") == F.col("oh"))))
    step = F.explode(F.array(F.lit(0), F.lit(1)))
    both = both.unionByName(held.withColumn("step", step).select("_id", "_h", (F.col("pos") + F.col("step")).alias("pos"), "oid", "oh", (F.col("opos") + F.col("step")).alias("opos"), F.lit(False).alias("alone")))
    return both.groupBy("_id", "_h").agg(F.collect_list(F.struct("pos", "oid", "oh", "opos", "alone")).alias("matches"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE, least_words: int = LEAST_WORDS, least_lines: int = LEAST_LINES, long_words: int = LONG_WORDS, lines_out: str = "_lines", deleted_out: str = "_deleted") -> DataFrame:
    """``docs`` with common blocks deleted from ``text_col``; ``lines_out`` and ``deleted_out`` count non-blank lines (columns
    of these names give way)."""
    found = alignments(docs, id_col, text_col, rare, least_words, long_words)
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    text = F.col(f"`{text_col}`").cast("string")
    packed = docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("_h"), text.alias("_t"), F.struct(F.lit(0).alias("_0"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest))).alias("_rest"))
    z = StructType([StructField("_z", BinaryType()) if f.name == "_t" else f for f in packed.schema.fields])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for b in core.slices(batches, 1024):
            raw, off = core.utf8(b.column(2))
            null = b.column(2).is_null().to_pylist()
            texts = [None if null[i] else press.compress(raw[off[i] : off[i + 1]].tobytes()) for i in range(len(off) - 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.binary()), b.column(3)], ["_id", "_h", "_z", "_rest"])

    joined = packed.mapInArrow(squeeze, z).alias("d").join(found.alias("f"), F.col("d._id").eqNullSafe(F.col("f._id")) & (F.col("d._h").eqNullSafe(F.col("f._h"))), "left").select("d._id", "d._z", "d._rest", "f.matches")
    out = StructType([joined.schema["_id"], StructField("_t", StringType()), joined.schema["_rest"], StructField("_lines", LongType()), StructField("_deleted", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in core.slices(batches):
            texts, lines, gone = [], [], []
            null = b.column(1).is_null().to_pylist()
            for i, text in enumerate(core.unsqueeze(b.column(1))):
                parts = split_lines(text)
                inked = [p for p, x in enumerate(parts) if x.strip()]
                lines.append(len(inked))
                found: dict = {}
                for m in b.column(3)[i].as_py() or []:
                    found.setdefault((m["oid"], m["oh"]), []).append((m["pos"], m["opos"], m["alone"]))
                cut = deleted(found, inked, least_lines)
                gone.append(len(cut))
                if cut:
                    left = [x for p, x in enumerate(parts) if p not in cut]
                    text = b"\n".join(left) if any(x.strip() for x in left) else b""
                texts.append(None if null[i] else text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary()).cast(pa.string()), b.column(2), pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], ["_id", "_t", "_rest", "_lines", "_deleted"])

    done = joined.mapInArrow(run, out)
    cols = {id_col: F.col("_id").alias(id_col), text_col: F.col("_t").alias(text_col)} | {c: F.col(f"_rest.c{i}").alias(c) for i, c in enumerate(rest)}
    return done.select(*(cols[c] for c in docs.columns if c not in (lines_out, deleted_out)), F.col("_lines").alias(lines_out), F.col("_deleted").alias(deleted_out))


def query(spark, sf_dir: str) -> DataFrame:
    got = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_deleted").alias("n_deleted"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))

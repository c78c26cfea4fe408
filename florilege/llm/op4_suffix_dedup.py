"""Suffix-array dedup: remove bytes covered by a fixed-length string that also starts elsewhere.

Method: longest-previous-factor arrays. A suffix array of the whole corpus can't be built in
one place, so candidates are first brought together: each 200-byte window belongs to an anchor
inside it, and only runs of windows whose anchor recurs go on (``repeats``). Of runs with equal content one
goes on for all. These are cut out with their surroundings, grouped by anchor and suffix-sorted in batches of a few
hundred KB; previous and next smaller positions in suffix order give each position's longest earlier
match. A start with an earlier match of ``length`` bytes is a later copy, the match's source the copy before it.
An anchor with many contents is dealt to groups of about ``PART`` of them, so no task gets it whole; what has no
earlier match in its group goes on as one hash per distinct window, counted across the groups by Spark.

Edge cases: a null or empty text and one shorter than ``length`` bytes keep everything (n_spans 0);
repeated rows are copies of each other and lose every covered byte (ties have no order here); bytes are counted on UTF-8;
a very long text is cut into overlapping blocks. Null ids are kept. An empty table gives an empty result. Other columns,
whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.llm import core, repeats
from florilege.llm.suffix import previous_factor
from florilege.session import stage

LENGTH = 200
GRAM = 96  # anchor size: long enough that common short lines don't become anchors
PART = 1024  # contents of one anchor in a task's group
BATCH = 1 << 18  # bytes suffix-sorted at once


def _runs(length: int, gram: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = core.utf8(b.column(1))
            keys = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for pieces in core.blocks(np.diff(off), length - 1):
                doc, frm, to = (np.array(x, dtype=np.int64) for x in zip(*pieces, strict=True))
                body = np.concatenate([raw[off[d] + f : off[d] + t] for d, f, t in pieces])
                ends = np.cumsum(to - frm)
                starts = ends - (to - frm)
                r = core.collapse(core.winnow(core.BYTE_CODE[body], starts, ends, length, gram), keys[doc])
                p = r["piece"]
                who = pa.array(doc[p])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(who), b.column(2).take(who), pa.array(r["lo"] - starts[p] + frm[p]), pa.array(r["n"].astype(np.int32)), pa.array(r["rel"].astype(np.int32)), pa.array(r["anchor"].view(np.int64)), pa.array(r["ctx"].view(np.int64)), pa.array(r["w"])],
                    ["_id", "_h", "lo", "n", "rel", "anchor", "ctx", "w"],
                )

    return run, f"_id {kind}, _h long, {repeats.RUN}"


def _cut(length: int, kind: str):
    """Bytes under each run, with the document's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(core.unsqueeze(b.column(2))):
                runs = b.column(3)[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array([i] * len(runs))), b.column(1).take(pa.array([i] * len(runs)))]
                    + [pa.array([r[x] for r in runs], t) for x, t in (("lo", pa.int64()), ("n", pa.int32()), ("rel", pa.int32()), ("anchor", pa.int64()), ("kind", pa.int32()), ("nctx", pa.int32()))]
                    + [pa.array([text[r["lo"] : r["lo"] + r["n"] - 1 + length] for r in runs], pa.binary())],
                    ["_id", "_h", "lo", "n", "rel", "anchor", "kind", "nctx", "bytes"],
                )

    return run, f"_id {kind}, _h long, lo long, n int, rel int, anchor long, kind int, nctx int, bytes binary"


def repeated_starts(raw: np.ndarray, off: np.ndarray, length: int, later_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Of texts raw[off[i]:off[i+1]]: at which positions a string of ``length`` starts that starts earlier too (the later
    copies), and at which one starts that starts elsewhere. An earliest copy is the source of a later one's longest
    previous factor; with later_only it counts as kept, so both results are the same."""
    lpf, source = previous_factor(raw, off, length)
    later = lpf >= length
    again = later.copy()
    if not later_only:
        again[source[later]] = True
    return later, again


def _sorted(length: int, part: int, kind: str):
    """Suffix-sorts batches of runs; a batch ends only between (anchor, part) groups. Spans of starts that
    recur in the batch have ``ask`` 0. Of an anchor in several parts, one row for each window that has
    no earlier copy in the batch follows: it may recur in another part (``ask`` 1: it wants to know, 2: it
    is settled and only counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            group = np.stack([b.column(5).to_numpy(), b.column(9).to_numpy()])
            _, off = core.utf8(b.column(8))
            cuts = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1
            at = 0
            if last != tuple(group[:, 0].tolist()) and size >= BATCH:
                yield from settle(held)
                held, size = [], 0
            for c in cuts.tolist():
                if size + off[c] - off[at] >= BATCH:
                    held.append(b.slice(at, c - at))
                    yield from settle(held)
                    held, size, at = [], 0, c
            held.append(b.slice(at))
            size += int(off[-1] - off[at])
            last = tuple(group[:, -1].tolist())
        yield from settle(held)

    def settle(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held) if held else None
        if t is None or not len(t):
            return
        t = t.combine_chunks()
        raw, off = core.utf8(t.column(8))
        raw, off = raw[off[0] : off[-1]], off - off[0]
        later, again = repeated_starts(raw, off, length)
        n, lo, rel = (t.column(i).to_numpy().astype(np.int64) for i in (3, 2, 4))
        solo = t.column(6).to_numpy() == repeats.SOLO
        hit = again & np.repeat(solo, np.diff(off))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
        s, e = edge[::2], edge[1::2]  # no span crosses texts: the last starts of a text lack bytes
        who = np.searchsorted(off, s, "right") - 1
        yield from rows(t, who, lo[who] + s - off[who], lo[who] + e - off[who], np.zeros(len(s), np.int32))
        split = t.column(7).to_numpy() > part
        if split.any():
            first = np.flatnonzero(~later & np.repeat(split, np.diff(off)))
            who = np.searchsorted(off, first, "right") - 1
            k = first - off[who]
            inside = k < n[who]
            first, who, k = first[inside], who[inside], k[inside]
            sums = core.prefix(core.BYTE_CODE[raw])
            code = core.mix(core.between(sums, first, first + length)).view(np.int64)
            ask = np.where(solo[who] & ~again[first], 1, 2).astype(np.int32)
            yield from rows(t, who, lo[who] + k, lo[who] + k + 1, ask, t.column(5).to_numpy()[who], (rel[who] - k).astype(np.int32), code)

    def rows(t, who, a, b, ask, anchor=None, rel=None, code=None) -> Iterator[pa.RecordBatch]:
        w, none = pa.array(who), np.zeros(len(who), np.int64)
        more = [pa.array(none if x is None else x).cast(kind_) for x, kind_ in ((anchor, pa.int64()), (rel, pa.int32()), (code, pa.int64()))]
        out = pa.Table.from_arrays([t.column(0).take(w), t.column(1).take(w), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(ask), *more], ["_id", "_h", "a", "b", "ask", "anchor", "rel", "code"])
        yield from out.to_batches(max_chunksize=65536)

    return run, f"_id {kind}, _h long, a long, b long, ask int, anchor long, rel int, code long"


def removal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int | None = None, part: int = PART) -> DataFrame:
    """Window starts that recur: ``_id, _h, a, b`` (starts a to b, b excluded; intervals may touch)."""
    gram = gram or max(1, length * GRAM // LENGTH)
    base = core.documents(docs, id_col, text_col)
    kind = core.id_type(base)
    seen = repeats.marked(base.select("_id", "_t", "_h").mapInArrow(*_runs(length, gram, kind)), "suffix-runs")
    ask = repeats.per_document(seen.where(F.col("kind") != repeats.SURE), ["lo", "n", "rel", "anchor", "kind", "nctx"], "runs")
    pieces = (
        core.squeezed(base).dropDuplicates(["_id", "_h"]).alias("d").join(ask.alias("r"), F.col("d._id").eqNullSafe(F.col("r._id")) & (F.col("d._h") == F.col("r._h")))
        .select("d._id", "d._h", "d._z", "r.runs").mapInArrow(*_cut(length, kind))
    )
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("_id", "_h", "lo"), F.ceil(F.col("nctx") / F.lit(part))))
    pieces = pieces.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "_id", "_h", "lo")
    got = stage(pieces.mapInArrow(*_sorted(length, part, kind)), "suffix-found")
    across = got.where("ask > 0").select("_id", "_h", F.col("a").alias("at"), (F.col("ask") == 1).alias("solo"), "anchor", "rel", "code")
    return repeats.sure_starts(seen).unionByName(got.where("ask = 0").select("_id", "_h", "a", "b")).unionByName(repeats.counted(across))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int | None = None, part: int = PART) -> DataFrame:
    """One row per document: ``id_col, kept`` (binary: the remaining bytes), ``spans`` (removed byte
    ranges, maximal, end excluded) and ``n_bytes``."""
    base = core.documents(docs, id_col, text_col)
    kind = core.id_type(base)
    spans = repeats.per_document(removal_spans(docs, id_col, text_col, length, gram, part), ["a", "b"], "starts")
    joined = core.squeezed(base).alias("d").join(spans.alias("s"), F.col("d._id").eqNullSafe(F.col("s._id")) & (F.col("d._h") == F.col("s._h")), "left").select("d._id", "d._z", "s.starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in core.slices(batches):
            kept, cut, size = [], [], []
            for i, text in enumerate(core.unsqueeze(b.column(1))):
                merged = merge(b.column(2)[i].as_py() or [], length)
                kept.append(b"".join(text[p:q] for p, q in gaps(merged, len(text))))
                cut.append([{"a": x, "b": y} for x, y in merged])
                size.append(len(text))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), pa.array(cut, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(size, pa.int64())], ["_id", "kept", "spans", "n_bytes"])

    return joined.mapInArrow(run, f"_id {kind}, kept binary, spans array<struct<a:long,b:long>>, n_bytes long").withColumnRenamed("_id", id_col)


def merge(starts: list[dict], length: int) -> list[tuple[int, int]]:
    """Covered ranges of window starts, touching ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"] - 1 + length) for s in starts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def gaps(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    edge = [0, *(x for s in spans for x in s), size]
    return list(zip(edge[::2], edge[1::2], strict=True))


def query(spark, sf_dir: str) -> DataFrame:
    got = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select(
        "doc_id", "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["b"] - s["a"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2(F.col("kept"), 256).alias("kept_sha256"),
    )

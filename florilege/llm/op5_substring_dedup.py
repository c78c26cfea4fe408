"""Substring dedup: remove words covered by a fixed-length word window that also starts elsewhere.

Method: Rabin-Karp. Each document's words are coded in 64 bits and every window of 35 words gets
its polynomial hash from prefix sums. Rows for all windows would be several times the text, so
windows are dealt to anchors first (``repeats``): an anchor seen once clears all its windows, runs of
equal hash count as repeated whole, and the windows of the remaining runs are counted one by one in
Spark by (anchor, place, hash). Repeated windows merge into maximal removal intervals.

Edge cases: null text has no words; documents with fewer than ``window`` words keep everything;
repeated rows are copies of each other; null ids are kept; an empty table gives an empty result. A very long
text is coded in blocks that overlap by a window; of equal windows (ties) every one goes, the first included; columns other than id
and text don't enter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.llm import core, repeats
from florilege.llm.op4_suffix_dedup import gaps, merge
from florilege.session import stage

WINDOW = 35
GRAM = 12


def _runs(window: int, gram: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = core.utf8(b.column(1))
            keys = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for docs, codes, woff in core.batch_words(raw, off):
                for pieces in core.blocks(np.diff(woff), window - 1):
                    doc, frm, to = (np.array(x, dtype=np.int64) for x in zip(*pieces, strict=True))
                    whole = bool((frm == 0).all() and (to == np.diff(woff)[doc]).all())
                    e = codes[woff[doc[0]] : woff[doc[-1] + 1]] if whole else np.concatenate([codes[woff[d] + f : woff[d] + t] for d, f, t in pieces])
                    ends = np.cumsum(to - frm)
                    starts = ends - (to - frm)
                    r = core.collapse(core.winnow(e, starts, ends, window, gram), keys[doc + docs.start])
                    p = r["piece"]
                    who = pa.array(doc[p] + docs.start)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(who), b.column(2).take(who), pa.array(r["lo"] - starts[p] + frm[p]), pa.array(r["n"].astype(np.int32)), pa.array(r["rel"].astype(np.int32)), pa.array(r["anchor"].view(np.int64)), pa.array(r["ctx"].view(np.int64)), pa.array(r["w"])],
                        ["_id", "_h", "lo", "n", "rel", "anchor", "ctx", "w"],
                    )

    return run, f"_id {kind}, _h long, {repeats.RUN}"


def _windows(window: int, kind: str):
    """The Rabin-Karp hashes of each asked run's windows, as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in core.slices(batches):
            for i, text in enumerate(core.unsqueeze(b.column(2))):
                raw = np.frombuffer(text, np.uint8)
                _, codes, _ = zip(*core.batch_words(raw, np.array([0, len(raw)])), strict=True)
                sums = core.prefix(np.concatenate(codes))
                runs = b.column(3)[i].as_py()
                n = np.array([r["n"] for r in runs], np.int64)
                who = np.repeat(np.arange(len(n)), n)
                k = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
                at = np.array([r["lo"] for r in runs], np.int64)[who] + k
                w = pa.array(np.full(len(who), i))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(w), b.column(1).take(w), pa.array(at), pa.array(np.array([r["kind"] for r in runs])[who] == repeats.SOLO), pa.array(np.array([r["anchor"] for r in runs], np.int64)[who]), pa.array((np.array([r["rel"] for r in runs])[who] - k).astype(np.int32)), pa.array(core.mix(core.between(sums, at, at + window)).view(np.int64))],
                    ["_id", "_h", "at", "solo", "anchor", "rel", "code"],
                )

    return run, f"_id {kind}, _h long, at long, solo boolean, anchor long, rel int, code long"


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int | None = None) -> DataFrame:
    """``_id, _h, a, b``: windows starting at words a to b (excluded) recur."""
    gram = gram or max(1, window * GRAM // WINDOW)
    base = core.documents(docs, id_col, text_col)
    kind = core.id_type(base)
    seen = repeats.marked(base.select("_id", "_t", "_h").mapInArrow(*_runs(window, gram, kind)), "word-runs")
    ask = repeats.per_document(seen.where(F.col("kind") != repeats.SURE), ["lo", "n", "rel", "anchor", "kind"], "runs")
    rows = (
        core.squeezed(base).dropDuplicates(["_id", "_h"]).alias("d").join(ask.alias("r"), F.col("d._id").eqNullSafe(F.col("r._id")) & (F.col("d._h") == F.col("r._h")))
        .select("d._id", "d._h", "d._z", "r.runs").mapInArrow(*_windows(window, kind))
    )
    return repeats.sure_starts(seen).unionByName(repeats.counted(stage(rows, "word-windows")))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int | None = None) -> DataFrame:
    """One row per document: ``id_col, kept`` (kept words joined by a space), ``spans`` (removed word
    ranges, maximal, end excluded) and ``n_words``."""
    base = core.documents(docs, id_col, text_col)
    kind = core.id_type(base)
    spans = repeats.per_document(repeated_windows(docs, id_col, text_col, window, gram), ["a", "b"], "starts")
    joined = core.squeezed(base).alias("d").join(spans.alias("s"), F.col("d._id").eqNullSafe(F.col("s._id")) & (F.col("d._h") == F.col("s._h")), "left").select("d._id", "d._z", "s.starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in core.slices(batches):
            kept, cut, size = [], [], []
            for i, text in enumerate(core.unsqueeze(b.column(1))):
                words = text.split()
                merged = merge(b.column(2)[i].as_py() or [], window)
                kept.append(b" ".join(w for p, q in gaps(merged, len(words)) for w in words[p:q]))
                cut.append([{"a": x, "b": y} for x, y in merged])
                size.append(len(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(cut, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(size, pa.int64())], ["_id", "kept", "spans", "n_words"])

    return joined.mapInArrow(run, f"_id {kind}, kept string, spans array<struct<a:long,b:long>>, n_words long").withColumnRenamed("_id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    got = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["b"] - s["a"]).alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
cov AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM rep)) r, range(0, 35) t(k)),
pos AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS txt, count(*) AS n FROM pos ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

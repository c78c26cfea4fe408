"""Fill-in-the-middle: a text is cut at two places and its pieces change order, so that a model learns to fill gaps.

Method: each text is decoded to a UTF-32 array of code points. Every code point has a class; where two neighbours
differ in class a unit ends (``flatnonzero``), so the boundaries of units are one array, from which two
are taken by rank. The three pieces are slices of the array and are encoded again. What is a unit depends on the classes:
``char`` gives each code point a class unlike its neighbours', ``word`` tells ink from white space, ``line`` the lines.

The two ranks, and whether and how a text is turned, come from a hash of its id: neither order nor partitioning has a
say, and a lost task repeats what it did.

Edge cases: null and empty texts stay as they are (``plain``), as do texts that hold a mark; a null id is hashed as no
digits at all; repeated rows are turned alike, each of them (there are no ties: rows don't meet); a text of
any length is handled whole, one at a time, in four bytes a code point; an empty table gives no rows; columns other than id and
text don't enter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.llm import core

#: fixed values: the marks before prefix, suffix and middle
MARKS = ("<P>", "<S>", "<M>")
PLAIN = 10  # of 100 texts so many stay as they are
SPM = 20  # of 100 others so many begin with the suffix

#: code points below 256 by class: white space or not
_INK = np.ones(256, bool)
_INK[[0x20, *range(0x09, 0x0E)]] = False


def classes(points: np.ndarray, unit: str) -> np.ndarray:
    """A class for each code point; units are what lies between changes of class."""
    if unit == "char":
        return (np.arange(len(points)) & 1).astype(np.uint8)
    if unit == "word":
        low = points < 256
        out = np.ones(len(points), np.uint8)
        out[low] = _INK[points[low]]
        return out
    if unit == "line":  # a line and its break are one unit
        ends = points == 10
        return ((np.cumsum(ends) - ends) & 1).astype(np.uint8)
    raise ValueError(f"no such unit: {unit}")


def boundaries(points: np.ndarray, unit: str = "char") -> np.ndarray:
    """Where units begin and end, both ends of the text included: one place more than there are units."""
    if not len(points):
        return np.zeros(1, np.int64)
    kind = classes(points, unit)
    return np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(points)]))


def turn(text: str, draws: tuple[int, int, int, int], unit: str = "char", marks: tuple[str, str, str] = MARKS, plain: int = PLAIN, spm: int = SPM) -> tuple[int, str, int | None, int | None, str]:
    """Code points, form, code points of prefix and middle, and the new text, by four drawn numbers."""
    points = np.frombuffer(text.encode("utf-32-le"), np.dtype("<u4"))
    if not text or draws[2] % 100 >= 100 - plain or any(m in text for m in marks):
        return len(points), "plain", None, None, text
    cuts = boundaries(points, unit)
    first, second = sorted((int(cuts[draws[0] % len(cuts)]), int(cuts[draws[1] % len(cuts)])))
    prefix, middle, suffix = (points[a:b].tobytes().decode("utf-32-le") for a, b in ((0, first), (first, second), (second, len(points))))
    p, s, m = marks
    if draws[3] % 100 < spm:
        return len(points), "spm", first, second - first, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return len(points), "psm", first, second - first, f"{p}{prefix}{s}{suffix}{m}{middle}"


def drawn(id_col: Column, seed: int = 1) -> Column:
    """Four numbers from the SHA-256 of seed and id."""
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(code, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", seed: int = 1, marks: tuple[str, str, str] = MARKS, plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """``id_col, n`` (code points), ``form`` (plain, psm or spm), ``prefix_chars, middle_chars`` (null if plain) and ``output``."""
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"), drawn(F.col(id_col), seed).alias("_r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core.occupy("op12")
        for b in core.slices(batches):
            got = [turn(t.as_py(), r, unit, marks, plain, spm) for t, r in zip(b.column(1), b.column(2).to_pylist(), strict=True)]
            n, form, first, middle, out = zip(*got, strict=True) if got else ((),) * 5
            cells = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(first, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cells], ["_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return base.mapInArrow(run, f"_id {core.id_type(base)}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("_id", id_col)


def restored(output: Column | str, form: Column | str, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made from. A piece holds no mark, and marks can't overlap with what stands beside
    them, so the first of each is the one that was set."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    p, s, m = marks

    def parts(a: str, b: str) -> tuple[Column, Column, Column]:
        head = F.substring_index(output, b, 1)
        rest = F.substr(output, F.length(head) + 1 + len(b))
        return F.substr(head, F.lit(1 + len(a))), F.substring_index(rest, m, 1), F.substring_index(rest, m, -1)

    psm, spm = parts(p, s), parts(s, p)
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)


def query(spark, sf_dir: str) -> DataFrame:
    got = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256"))


_H = "('0x' || substring(sha256('1:' || coalesce(doc_id::VARCHAR, '')), {at}, 8))::BIGINT"
ORACLE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, {", ".join(f"{_H.format(at=1 + 8 * i)} AS h{i + 1}" for i in range(4))} FROM documents),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

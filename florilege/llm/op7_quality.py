"""Quality rules learnt as a decision list.

Method: sequential covering. From labelled rows, one rule after another is grown - a conjunction of
threshold tests on text statistics, each test the one with the best FOIL gain - then pruned back on rows
set aside, and the rows it covers leave the table, until no rule is precise enough. The list comes out
as ordered Spark conditional expressions, which any table with the statistics can be filtered by.

Statistics are taken in numpy over whole texts, a few million characters at a time; learning sees at
most ``max_labelled`` labelled rows (the smallest hashes of their ids), in one driver-side table.

Edge cases: null and empty texts have no words and zeros everywhere (and fail the base rule); missing
labels or a single class give an empty list, which keeps everything; repeated rows and null ids are kept; a very long
text is counted whole, in one sweep of its own; of equally good tests (ties) the first statistic in the order of FEATURES counts; an empty
table gives no rows; columns other than id and text don't enter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.llm import core
from florilege.session import stage

MAX_LABELLED = 20_000
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks")
#: statistics that rules may test, from the counts; all are shares, so text length alone decides nothing
FEATURES = {
    "mean_word": ("word_chars", "n_words"), "symbol_rate": ("n_symbols", "n_words"), "dup_line_rate": ("n_dup_lines", "n_lines"), "repeat_rate": ("n_repeat_words", "n_words"),
    "upper_rate": ("n_upper", "n_letters"), "digit_rate": ("n_digits", "word_chars"), "mark_rate": ("n_marks", "word_chars"),
}


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL = _flags(SYMBOLS)
_UPPER = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _flags("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _flags("0123456789")
_MARK = _flags("!?.,;:")


def _per(off: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Hits within each off[i]:off[i + 1]."""
    total = np.concatenate(([0], np.cumsum(hits, dtype=np.int64)))
    return total[off[1:]] - total[off[:-1]]


def _repeats(doc: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of (doc, code) pairs: how often each pair occurs, and whether it's the pair's first occurrence."""
    n = len(code)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    key = core.mix(code ^ core.mix(doc.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.concatenate(([True], k[1:] != k[:-1]))
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    count, first = np.empty(n, np.int64), np.empty(n, bool)
    count[order] = np.repeat(size, size)
    first[order] = new
    return count, first


def counts(raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The COUNTS of each text raw[off[i]:off[i + 1]]."""
    size = np.diff(off)
    joint = np.full(int(size.sum()) + len(size), 0x0A, np.uint8)  # texts, a line break after each
    end = np.cumsum(size + 1) - 1
    take = np.ones(len(joint), bool)
    take[end] = False
    joint[take] = raw[off[0] : off[-1]]
    at = np.concatenate(([0], end + 1))
    ink = ~core.IS_SPACE[joint]
    out = {
        "word_chars": _per(at, ink & ((joint & 0xC0) != 0x80)), "n_symbols": _per(at, _SYMBOL[joint]), "n_upper": _per(at, _UPPER[joint]),
        "n_letters": _per(at, _LETTER[joint]), "n_digits": _per(at, _DIGIT[joint]), "n_marks": _per(at, _MARK[joint]),
    }
    ws, we = core.words_of(joint)
    woff = np.append(np.searchsorted(ws, at[:-1]), len(ws))
    out["n_words"] = np.diff(woff)
    sums = core.prefix(core.BYTE_CODE[joint])
    code = core.mix(core.between(sums, ws, we) ^ core.mix((we - ws).astype(np.uint64)))
    doc = np.repeat(np.arange(len(size)), np.diff(woff))
    hit = np.zeros(len(ws), bool)
    if len(ws) > 2:
        three = core.grams(code, 3)
        inner = np.flatnonzero(doc[2:] == doc[:-2])
        often, _ = _repeats(doc[inner], three[inner])
        for k in range(3):
            hit[inner[often > 1] + k] = True
    out["n_repeat_words"] = _per(woff, hit)
    le = np.flatnonzero(joint == 0x0A)
    ls = np.concatenate(([0], le[:-1] + 1))
    wet = np.concatenate(([0], np.cumsum(ink)))
    full = wet[le] > wet[ls]  # lines with a word
    ldoc = np.searchsorted(at, ls, "right") - 1
    lines, ldoc = core.mix(core.between(sums, ls, le) ^ core.mix((le - ls).astype(np.uint64)))[full], ldoc[full]
    _, first = _repeats(ldoc, lines)
    out["n_lines"] = np.bincount(ldoc, minlength=len(size))
    out["n_dup_lines"] = np.bincount(ldoc[~first], minlength=len(size))
    return out


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the COUNTS (long) of each document."""
    base = core.documents(docs, id_col, text_col).select("_id", "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = core.utf8(b.column(1))
            at, n = 0, len(off) - 1
            while at < n:
                to = max(at + 1, int(np.searchsorted(off, off[at] + core.BLOCK, "right")) - 1)
                got = counts(raw, off[at : to + 1])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], ["_id", *COUNTS])
                at = to

    return base.mapInArrow(run, f"_id {core.id_type(base)}, " + ", ".join(f"{c} long" for c in COUNTS)).withColumnRenamed("_id", id_col)


def feature(name: str) -> Column:
    top, under = FEATURES[name]
    return F.col(top) / F.greatest(F.col(under), F.lit(1))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool  # holds where the statistic is >= value, else where it is < value
    value: float

    def column(self) -> Column:
        return feature(self.feature) >= self.value if self.above else feature(self.feature) < self.value

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.value if self.above else x[self.feature] < self.value

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.value:g}"


@dataclass(frozen=True)
class Rule:
    """If all tests hold, the document is rejected."""

    tests: tuple[Test, ...]
    hits: int
    misses: int

    def column(self) -> Column:
        out = F.lit(True)
        for t in self.tests:
            out = out & t.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.tests)) + f"  # {self.hits} bad, {self.misses} good rows"


def holds(tests: tuple[Test, ...], x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for t in tests:
        out &= t.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> tuple[Test, ...]:
    tests: tuple[Test, ...] = ()
    live = np.ones(len(bad), bool)
    while len(tests) < most and (live & ~bad).any():
        p0, n0 = int((live & bad).sum()), int((live & ~bad).sum())
        best = None
        for name in x:
            v, y = x[name][live], bad[live]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            if not len(cut):
                continue
            below = np.cumsum(y)[cut - 1]
            for above, p, n in ((False, below, cut - below), (True, p0 - below, (len(v) - cut) - (p0 - below))):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1.0)
                i = int(np.argmax(gain))
                if gain[i] > 1e-9 and (best is None or gain[i] > best[0] + 1e-12):
                    best = (float(gain[i]), Test(name, above, float(np.round((v[cut[i] - 1] + v[cut[i]]) / 2, 6))))
        if best is None:
            break
        tests += (best[1],)
        live &= best[1].holds(x)
    return tests


def _prune(tests: tuple[Test, ...], x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Test, ...]:
    """Drop final tests while the pruning rows are covered no worse: (p - n) / (p + n)."""

    def worth(t: tuple[Test, ...]) -> float:
        c = holds(t, x)
        p, n = int((c & bad).sum()), int((c & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    best = max(range(1, len(tests) + 1), key=lambda k: (worth(tests[:k]), -k))
    return tests[:best]


def induce(x: dict[str, np.ndarray], bad: np.ndarray, turn: np.ndarray, most_rules: int = 12, most_tests: int = 4, precision: float = 0.8, least: int = 4) -> list[Rule]:
    """Rules for the bad rows. ``turn`` deals rows out: 0 prunes, the rest grow."""
    live, rules = np.ones(len(bad), bool), []
    while len(rules) < most_rules:
        g, p = live & (turn != 0), live & (turn == 0)
        if not (g & bad).any():
            break
        tests = _grow({k: v[g] for k, v in x.items()}, bad[g], most_tests)
        if not tests:
            break
        tests = _prune(tests, {k: v[p] for k, v in x.items()}, bad[p]) if (p & bad).any() else tests
        c = holds(tests, x) & live
        hits, misses = int((c & bad).sum()), int((c & ~bad).sum())
        if hits < least or hits < precision * (hits + misses):
            break
        rules.append(Rule(tests, hits, misses))
        live &= ~c
    return rules


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """A decision list from ``labels`` (1 good, 0 bad) and the statistics of their documents."""
    chosen = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull())
    chosen = chosen.groupBy("_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_id", F.lit(17)), "_id").limit(max_labelled)
    rows = stats.join(F.broadcast(chosen), stats[id_col] == F.col("_id")).select("_id", "_y", F.pmod(F.xxhash64("_id", F.lit(19)), F.lit(3)).alias("_turn"), *COUNTS)
    t = rows.orderBy("_id", *COUNTS).limit(2 * max_labelled).toPandas()
    if not len(t) or t["_y"].nunique() < 2:
        return []
    x = {k: t[a].to_numpy(float) / np.maximum(t[b].to_numpy(float), 1) for k, (a, b) in FEATURES.items()}
    return induce(x, t["_y"].to_numpy() == 0, t["_turn"].to_numpy())


def rejected(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects the document, 0 if none does: an ordered conditional."""
    out = None
    for i, r in enumerate(rules, 1):
        out = F.when(r.column(), i) if out is None else out.when(r.column(), i)
    return out.otherwise(0) if out is not None else F.lit(0)


def query(spark, sf_dir: str) -> DataFrame:
    stats = stage(statistics(spark.read.parquet(f"{sf_dir}/documents.parquet")), "quality-statistics")
    rules = learn(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (rejected(rules) == 0)).alias("kept"))

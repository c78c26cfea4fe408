"""Toxicity by class-conditional Kneser-Ney language models.

Method: two interpolated bigram models, of toxic and of ordinary text, with absolute discounts. After a word u, a
word's probability is its discounted count after u plus what the discount leaves times its unigram probability; that
is its discounted continuation count (in how many pairs of neighbours it comes second, a pair counting
once in a document) plus what that discount leaves times one distribution shared by both classes: the
continuation counts of all documents. Class counts come from every labelled row that isn't set aside for the link, one of
each text. Entries are chosen by significance: a word or pair whose counts in both classes are what the next
lower order lets expect weighs nothing, since both classes back off there by the same distribution. Without
that choice the noise of some hundred frequent words outweighs one rare expression. A document's feature is
the difference of the two log-likelihoods per word; a logistic link, fitted on at most ``max_linked`` labelled rows that
the models haven't seen, turns it into a score and decides between two levels and two tolerances of significance, with pairs and without.

Sizes: all counts stay distributed. What is broadcast: labels if there are at most ``FEW`` (else they are joined by a
shuffle), a bitmap of fixed size, and the entries, whose number the level bounds: with sqrt(2 ln V) standard
deviations for V words about one of those that don't differ is taken by chance, with sqrt(ln V) some sqrt(V). How the rows are joined doesn't change what is
learnt. Pairs in fewer than two toxic texts are never entries.

Edge cases: null and empty texts (and texts without words) get the score of the link at zero; labels that
are null or lack a document are ignored; if a class has no training row, or none
among the rows that fit the link (very few labels), every score is the share of toxic rows (0 without labels); repeated rows are scored alike and counted once; rows with one id and different
labels are toxic; null ids are scored; a very long text is coded block by block; ties don't arise; an empty table gives
an empty result; other columns, whatever their names, stay.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.llm import core
from florilege.llm.op8_decontamination import NORMAL
from florilege.session import stage

MAX_LINKED = 5_000  # labelled rows that fit the link, at most a quarter of them
DISCOUNT = 0.75
LEVEL = 3.0  # standard deviations from which a count is an entry: this or, if that is more, sqrt(ln V) for V words; and sqrt(2 ln V)
TOLERANCES = (0.2, 0.5)  # and a share of the expected count, for the mix of languages
FEW = 2_000_000  # labels that are broadcast
BITS = 1 << 24
_LUT = np.frombuffer(NORMAL, np.uint8)


def crc_mod(id_col: str | Column, k: int) -> Column:
    """crc32 of the id as text, modulo k."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(k))


@dataclass
class Model:
    """Sorted word and pair codes with what each adds to log P(toxic) - log P(ordinary)."""

    word: np.ndarray  # codes
    gain: np.ndarray  # of a word after an unknown context
    other: float  # of a word outside the vocabulary
    pair: np.ndarray
    pair_gain: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    flat: float | None = None  # the score of every document where nothing could be learnt
    loss: float | None = None  # on the tuning rows

    def features(self, codes: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Mean gain per word of each document."""
        n = np.diff(off)
        if not len(codes):
            return np.zeros(len(n))
        gain = np.full(len(codes), self.other)
        if len(self.word):
            at = np.minimum(np.searchsorted(self.word, codes), len(self.word) - 1)
            known = self.word[at] == codes
            gain[known] = self.gain[at[known]]
        if len(self.pair):
            first = np.zeros(len(codes), bool)
            first[off[:-1][n > 0]] = True
            two = pair_codes(codes)
            p = np.minimum(np.searchsorted(self.pair, two), len(self.pair) - 1)
            hit = np.flatnonzero((self.pair[p] == two) & ~first[1:])
            gain[hit + 1] = self.pair_gain[p[hit]]
        total = np.concatenate(([0.0], np.cumsum(gain)))
        return (total[off[1:]] - total[off[:-1]]) / np.maximum(n, 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.flat) if self.flat is not None else 1 / (1 + np.exp(-np.clip(self.slope * x + self.shift, -40, 40)))


def pair_codes(codes: np.ndarray) -> np.ndarray:
    return core.mix(codes[:-1] * core.BASE + codes[1:])


def normal_words(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    return core.batch_words(_LUT[raw], off)


def _counts(pairs: bool, wanted=None):
    """(kind, a, b, y, n) of a batch of (text, class) rows. Within a document a pair of neighbours counts once. Kind 1: how
    often ``a`` is the second word of a pair (the first word of a text follows a mark); 3: how often the first; 2: the
    pairs themselves (``pairs``), or only those that a bitmap of pair codes holds (``wanted``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core.occupy("toxicity")
        for batch in batches:
            raw, off = core.utf8(batch.column(0))
            label = batch.column(1).to_numpy()
            for docs, codes, woff in normal_words(raw, off):
                if not len(codes):
                    continue
                doc = np.repeat(np.arange(len(docs)), np.diff(woff))
                left = np.concatenate((codes[:1] * core.U(0), codes[:-1]))
                left[woff[:-1][np.diff(woff) > 0]] = 0
                two = core.mix(left * core.BASE + codes)
                _, once = np.unique(core.mix(two ^ core.mix(doc.astype(np.uint64))), return_index=True)
                y = label[docs.start : docs.stop].astype(np.int32)[doc[once]]
                a, b = left[once], codes[once]
                kinds = [] if wanted is not None else [(1, b, np.zeros(len(b), np.uint64), y), (3, a, np.zeros(len(a), np.uint64), y)]
                if pairs or wanted is not None:
                    inner = a != 0
                    if wanted is not None:
                        slot = (two[once] & core.U(BITS - 1)).astype(np.int64)
                        inner &= ((wanted.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1).astype(bool)
                    kinds.append((2, a[inner], b[inner], y[inner]))
                for kind, u, v, t in kinds:
                    by = np.lexsort((t, v, u))
                    u, v, t = u[by], v[by], t[by]
                    if len(u):
                        new = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (v[1:] != v[:-1]) | (t[1:] != t[:-1]))))
                        n = np.diff(np.append(new, len(u)))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(new), kind, np.int32)), pa.array(u[new].view(np.int64)), pa.array(v[new].view(np.int64)), pa.array(t[new]), pa.array(n)], ["kind", "a", "b", "y", "n"])

    return run, "kind int, a long, b long, y int, n long"


def _by_class(counted: DataFrame, *keys: str) -> DataFrame:
    return counted.groupBy(*keys).agg(*(F.sum(F.when(F.col("y") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)))


def apart(count: np.ndarray, expected: np.ndarray, level: float, tolerance: float) -> np.ndarray:
    """Whether a count is further from the expected one than ``level`` standard deviations and a share of it."""
    return np.abs(count - expected) > level * np.sqrt(expected + 1) + tolerance * expected


def estimate(words: dict, pairs: dict, totals: dict, level: float, tolerance: float, bigrams: bool = True) -> Model:
    """Two interpolated models over one shared distribution. words: ``code``, continuation counts ``k0``, ``k1`` of the
    classes, ``s`` of all documents, ``l0``, ``l1`` (pairs that begin with the word); pairs: ``a``, ``b``, ``n0``, ``n1`` and ``r0``,
    ``r1`` (sums over the pairs of ``a`` of their discounted counts); totals: sums of k0, k1 and s, and how many words
    have k0, k1. A word or pair whose counts are what the next lower order lets expect in both classes isn't an
    entry of its own: both classes back off there, by the same distribution."""
    by = np.argsort(words["code"])
    code, s = words["code"][by], words["s"][by].astype(float)
    k = [words[f"k{c}"][by].astype(float) for c in (0, 1)]
    size = [max(1.0, totals["k0"]), max(1.0, totals["k1"])]
    shared = np.maximum(s, 0.5) / max(1.0, totals["s"])
    p = [np.maximum(k[c] - DISCOUNT, 0) / size[c] + DISCOUNT * totals[f"t{c}"] / size[c] * shared for c in (0, 1)]
    chosen = apart(k[0], shared * size[0], level, tolerance) | apart(k[1], shared * size[1], level, tolerance)
    # what the entries leave goes to all other words alike
    rest = [max(1e-9, 1 - float(p[c][chosen].sum())) / max(1e-9, 1 - float(shared[chosen].sum())) for c in (0, 1)]
    q = [np.where(chosen, p[c], rest[c] * shared) for c in (0, 1)]
    gain = np.log(q[1]) - np.log(q[0])
    other = float(np.log(rest[1]) - np.log(rest[0]))
    two, two_gain = np.zeros(0, np.uint64), np.zeros(0)
    if bigrams and len(pairs["a"]) and len(code):
        ia, ib = (np.minimum(np.searchsorted(code, pairs[x]), len(code) - 1) for x in ("a", "b"))
        ok = (code[ia] == pairs["a"]) & (code[ib] == pairs["b"])
        ia, ib = ia[ok], ib[ok]
        n = [pairs[f"n{c}"][ok].astype(float) for c in (0, 1)]
        given = [np.maximum(words[f"l{c}"][by][ia].astype(float), 1.0) for c in (0, 1)]
        # P(w | u): discounted count after u, and what the discount takes (and pairs that are no expressions) by P(w)
        cond = [np.maximum(n[c] - DISCOUNT, 0) / given[c] + np.clip(1 - pairs[f"r{c}"][ok] / given[c], 1e-3, 1) * q[c][ib] for c in (0, 1)]
        odds = q[1][ib] * given[1] / np.maximum(q[0][ib] * given[0], 1e-300)
        likely = odds / (1 + odds)
        take = apart(n[1], (n[0] + n[1]) * likely, level, tolerance) | apart(n[0], (n[0] + n[1]) * (1 - likely), level, tolerance)
        two = core.mix(pairs["a"][ok][take] * core.BASE + pairs["b"][ok][take])
        two_gain = (np.log(cond[1]) - np.log(cond[0]))[take]
        order = np.argsort(two)
        two, two_gain = two[order], two_gain[order]
    return Model(code[chosen], gain[chosen], other, two, two_gain)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and shift of a one-feature logistic regression, by damped Newton steps."""
    scale = float(np.std(x)) or 1.0
    z, w = x / scale, np.zeros(2)
    a = np.column_stack([z, np.ones(len(z))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (y - p) - 1e-3 * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.eye(2) * 1e-3
        step = np.linalg.solve(hess, grad)
        w = w + step * min(1.0, 5.0 / (np.abs(step).max() + 1e-9))
    return float(w[0] / scale), float(w[1])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train: Column | None = None, max_linked: int = MAX_LINKED) -> Model:
    """Fit on labelled rows for which ``train`` (a condition on ``id_col``) holds."""
    chosen = labels.where(train) if train is not None else labels
    chosen = chosen.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull())
    chosen = stage(chosen.groupBy("_id").agg(F.max("_y").alias("_y")), "toxicity-labels")
    base = core.documents(docs, id_col, text_col)
    empty = np.zeros(0, np.uint64)
    labelled = chosen.count()
    small = labelled <= FEW
    # of labelled copies one counts; ids and hashes only, the texts stay where they are
    each = base.select("_id", "_h").join(F.broadcast(chosen) if small else chosen, "_id").groupBy("_h", "_id").agg(F.max("_y").alias("_y"), F.count(F.lit(1)).alias("n"))
    one = each.groupBy("_h").agg(F.min(F.struct("_id", "n")).alias("m"), F.max("_y").alias("_y")).select("_h", "m._id", "_y", F.col("m.n").alias("n"))
    part = min(0.25, max_linked / max(1, labelled))  # fits the link and chooses level and tolerance; the models don't see it
    one = stage(one.withColumn("tune", F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1 << 20)) < int(part * (1 << 20))), "toxicity-chosen")
    share = {r[0]: r[1] for r in one.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(share) < 2:
        return Model(empty, np.zeros(0), 0.0, empty, np.zeros(0), flat=1.0 if share.get(1) else 0.0)
    flat = share[1] / sum(share.values())
    held, again = one.where("n = 1").drop("n"), one.where("n > 1").drop("n")
    rows = base.join(F.broadcast(held) if small else held, ["_id", "_h"])
    if again.limit(1).count():  # a repeated row counts once; only the texts of such rows move
        rows = rows.unionByName(base.join(F.broadcast(again) if small else again, ["_id", "_h"]).dropDuplicates(["_id", "_h"]))
    rows = rows.select("_t", "_y", "tune", "_id")
    seen = rows.where("NOT tune")
    counted = seen.select("_t", "_y").mapInArrow(*_counts(False)).groupBy("kind", "a").agg(*(F.sum(F.when(F.col("y") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)))
    counted = stage(counted, "toxicity-words")
    shared = base.select("_t", F.lit(0).alias("_y")).mapInArrow(*_counts(False)).where("kind = 1").groupBy("a").agg(F.sum("n").alias("s"))
    shared = stage(shared, "toxicity-shared")  # of all documents
    ends, begins = (counted.where(F.col("kind") == k).select("a", F.col("n0").alias(f"{x}0"), F.col("n1").alias(f"{x}1")) for k, x in ((1, "k"), (3, "l")))
    totals = ends.agg(*(F.coalesce(F.sum(f"k{c}"), F.lit(0)).cast("double").alias(f"k{c}") for c in (0, 1)), *(F.sum((F.col(f"k{c}") > 0).cast("double")).alias(f"t{c}") for c in (0, 1))).first().asDict()
    totals |= shared.agg(F.sum("s").cast("double").alias("s"), F.count(F.lit(1)).alias("v")).first().asDict()
    if not totals["k0"] or not totals["k1"]:
        return Model(empty, np.zeros(0), 0.0, empty, np.zeros(0), flat=flat)
    # pairs that two toxic texts hold are the expressions; ordinary texts are asked about these only
    toxic = seen.where("_y = 1").select("_t", "_y").mapInArrow(*_counts(True)).where("kind = 2").groupBy("a", "b").agg(F.sum("n").alias("n1")).where("n1 > 1")
    toxic = stage(toxic, "toxicity-pairs")
    marks = docs.sparkSession.sparkContext.broadcast(_bitmap(toxic))
    plain = seen.where("_y = 0").select("_t", "_y").mapInArrow(*_counts(False, marks)).groupBy("a", "b").agg(F.sum("n").alias("n0"))
    both = toxic.join(plain, ["a", "b"], "left").select("a", "b", F.coalesce("n0", F.lit(0)).alias("n0"), "n1")
    both = stage(both, "toxicity-expressions")
    marks.unpersist()
    left = [F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0)) for c in (0, 1)]
    spent = both.groupBy("a").agg(F.sum(left[0]).alias("r0"), F.sum(left[1]).alias("r1"))
    # candidates for entries: words and pairs that the loosest setting may take, and the words of such pairs
    v = math.log(max(3, totals["v"]))
    usable = sorted({max(LEVEL, math.sqrt(v)), math.sqrt(2 * v)})
    level = usable[0]

    def far(n: Column, e: Column, level: float) -> Column:
        return F.abs(n - e) > level * F.sqrt(e + 1) + TOLERANCES[0] * e

    table = ends.join(shared, "a").join(begins, "a", "left").fillna(0, ["l0", "l1"])
    table = stage(table, "toxicity-table")
    expect = [F.col("s") / totals["s"] * totals[f"k{c}"] for c in (0, 1)]
    word = table.where(far(F.col("k0"), expect[0], level) | far(F.col("k1"), expect[1], level)).select("a", "s", "k0", "k1", "l0", "l1")
    first, second = (table.select(F.col("a").alias(x), *(F.col(f"{y}{c}").alias(f"{x}{y}{c}") for y in "kl" for c in (0, 1))) for x in ("a", "b"))
    odd = both.join(first, "a").join(second, "b")
    n = F.col("n0") + F.col("n1")
    ratio = (F.col("bk1") + 0.5) / totals["k1"] * F.greatest("al1", F.lit(1)) / ((F.col("bk0") + 0.5) / totals["k0"] * F.greatest("al0", F.lit(1)))
    e1 = n * ratio / (1 + ratio)
    # the lower order may also back off to the shared distribution, where both classes agree
    ratio_shared = F.greatest("al1", F.lit(1)) / F.greatest("al0", F.lit(1))
    e2 = n * ratio_shared / (1 + ratio_shared)
    odd = odd.where(far(F.col("n1"), e1, level) | far(F.col("n0"), n - e1, level) | far(F.col("n1"), e2, level) | far(F.col("n0"), n - e2, level)).join(spent, "a").select("a", "b", "n0", "n1", "r0", "r1")
    odd = stage(odd, "toxicity-odd")
    inside = odd.select("a").unionByName(odd.select(F.col("b").alias("a"))).distinct()
    word = stage(word.unionByName(table.join(inside, "a", "left_semi").select("a", "s", "k0", "k1", "l0", "l1")).distinct(), "toxicity-entries")
    kept, pairs = word.toPandas(), odd.toPandas()

    def columns(t, codes: tuple[str, ...]) -> dict:
        return {c: t[c].to_numpy(np.int64).view(np.uint64) if c in codes else t[c].to_numpy() for c in t.columns}

    words = columns(kept, ("a",))
    words["code"] = words.pop("a")
    models = [estimate(words, columns(pairs, ("a", "b")), totals, level, tolerance, bigrams) for level in usable for tolerance in TOLERANCES for bigrams in (True, False)]
    sent = docs.sparkSession.sparkContext.broadcast(models)
    held = rows.where("tune").select("_t", "_y").mapInArrow(_features(sent), "x array<double>, y int").toPandas()
    sent.unpersist()
    y = held["y"].to_numpy(float)
    if len(set(y)) < 2:
        models[0].flat = flat
        return models[0]
    x = np.array(held["x"].tolist())
    best = None
    for i, m in enumerate(models):
        m.slope, m.shift = logistic(x[:, i], y)
        p = np.clip(m.scores(x[:, i]), 1e-6, 1 - 1e-6)
        loss = float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
        m.loss = loss
        if best is None or loss < best[0] - 1e-12:
            best = (loss, m)
    return best[1]


def _bitmap(pairs: DataFrame) -> np.ndarray:
    """Which of ``BITS`` slots the pair codes fall on, as packed bits: of fixed size, whatever the number of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS, bool)
        for b in batches:
            a, c = (b.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            bits[(core.mix(a * core.BASE + c) & core.U(BITS - 1)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], ["bits"])

    out = np.zeros(BITS // 8, np.uint8)
    for r in pairs.select("a", "b").coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():  # eight rows of fixed size
        out |= np.frombuffer(zlib.decompress(r.bits), np.uint8)
    return out


def _features(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = core.utf8(b.column(0))
            rows = []
            for _, codes, woff in normal_words(raw, off):
                rows += np.column_stack([m.features(codes, woff) for m in shared.value]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with the column ``out`` (0 to 1), which takes the place of one of that name; in one pass."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    shared = docs.sparkSession.sparkContext.broadcast(model)
    every = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]  # a name may hold dots or be ``out``
    packed = docs.select(F.struct(*every).alias("_row"), F.col(f"`{text_col}`").cast("string").alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core.occupy("toxicity")
        m = shared.value
        for b in batches:
            raw, off = core.utf8(b.column(1))
            x = [m.scores(m.features(codes, woff)) for _, codes, woff in normal_words(raw, off)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(x) if x else np.zeros(0))], ["_row", "_x"])

    got = packed.mapInArrow(run, StructType([packed.schema["_row"], StructField("_x", DoubleType())]))
    return got.select(*(F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns) if c != out), F.col("_x").alias(out))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), train=crc_mod("doc_id", 5) != 0)
    got = score(docs.select("doc_id", "text"), model)
    return got.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))

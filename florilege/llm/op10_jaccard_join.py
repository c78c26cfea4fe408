"""N-gram Jaccard join: documents whose word-shingle sets are alike, and the components they form.

Method: T-occurrence search as in DivideSkip. Two sets with Jaccard >= t share at least
T = ceil(t |x|) shingles, so any partner of x stands in at least four of its |x| - T + 4 shortest
inverted lists: those short lists are merged for candidates, across the corpus by shuffles, and every candidate of a set,
from whatever step, is then searched for in the inverted lists of that set's candidates (``t_occurrence``): short
lists merged, long ones only probed by binary search for a candidate that can still reach the required overlap. (Sets
too small to be alike to a different set are in no list.) Which lists are long is known from a counting
sketch of fixed size over all shingles of all documents, so a passage shared by a third of the
corpus is among the lists that are probed, never merged. The order decides on speed only, not on the result.

Equal sets are one node, however many documents have them (a worker hands each on once). Links are
first tested between neighbours in a list (sorted by size), then components are formed; for a few rounds one
member of each component of a list is tested with one of the next component, which joins what belongs
together, so the members of a group of near copies aren't paired off. At last every pair of a list
that is still in different components is tested, so no link is lost.

Sizes: shingles are 64-bit hashes; the sketch (2**22 counters) is the only thing broadcast.

Edge cases: null, empty or blank texts have an empty set and link with nothing; fewer words than
``words`` make one shingle; repeated rows link with each other; null ids are kept and take the smallest
id of their component, if it has one. Ties (equal sizes, equal sets) are links like others. A very long text is one
set, coded block by block. An empty table gives an empty result. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from florilege.llm import core
from florilege.llm.components import components
from florilege.session import stage

WORDS = 4
THRESHOLD = Fraction(85, 100)
SLOTS = 1 << 22
LONG = 64  # sets of a list that counts as long, beyond what other lists add to its slot
PARTS = 64  # the sketch travels in as many pieces
NEAR = 2  # neighbours tested first
LIGHT = 200_000  # pairs that are broadcast rather than joined by a shuffle of texts
CROWD = 256  # a list with more members still apart is searched block by block
BLOCK = 256  # sets of a block
SHARED = 4  # short lists in which partners must meet
ROUNDS = 1  # of tests between components of a list before all that are still apart are paired


def shingles(codes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one document's word codes."""
    n = len(codes)
    if not n:
        return codes
    if n < k:
        return core.mix(core.grams(codes, n) ^ core.U(n))
    return np.unique(core.mix(core.grams(codes, k)))


def sets(raw: np.ndarray, off: np.ndarray, k: int) -> Iterator[np.ndarray]:
    for docs, codes, woff in core.batch_words(raw, off, lower=True):
        for i in range(len(docs)):
            yield shingles(codes[woff[i] : woff[i + 1]], k)


def set_code(s: np.ndarray, seed: int) -> int:
    return int(core.mix(np.bitwise_xor.reduce(core.mix(s + core.U(seed)))[None] ^ core.mix(s.sum(dtype=np.uint64)[None]))[0]) if len(s) else 0


def required(t: Fraction, n: int) -> int:
    """The least overlap of a set of n shingles with any partner."""
    return -(-n * t.numerator // t.denominator)


def smallest(t: Fraction) -> int:
    """The least size of a set that can be alike to a different one: t / (1 - t)."""
    return -(-t.numerator // (t.denominator - t.numerator)) if t < 1 else 1 << 62


def meetings(t: Fraction) -> int:
    """In how many short lists partners meet at least (T of the search): ``SHARED``, or all they share if that is less."""
    return min(SHARED, required(t, smallest(t)))


def alike(x: np.ndarray, y: np.ndarray, t: Fraction) -> bool:
    """Jaccard >= t, by probing the longer sorted set for the shorter one's shingles."""
    if len(x) > len(y):
        x, y = y, x
    if len(x) * t.denominator < len(y) * t.numerator:
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return both * t.denominator >= t.numerator * (len(x) + len(y) - both)


def _count(sketch: np.ndarray, held: list[np.ndarray]) -> None:
    """Add the shingles of some sets to the sketch, and forget the sets."""
    slot, n = np.unique((np.concatenate(held) & core.U(SLOTS - 1)).astype(np.int64), return_counts=True)
    sketch[slot] += n.astype(np.uint32)
    held.clear()


def _survey(k: int, kind: str):
    """A row per document (size, two codes of its set), and at the end the partition's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        core.occupy("jaccard")

        sketch = np.zeros(SLOTS, np.uint32)
        names = ["_id", "_h", "n", "c", "c2", "part", "blob"]
        kinds = None
        held: list[np.ndarray] = []
        for b in batches:
            kinds = b.schema.field(0).type
            raw, off = core.utf8(b.column(1))
            n, c, c2 = [], [], []
            for s in sets(raw, off, k):
                n.append(len(s))
                c.append(set_code(s, 1))
                c2.append(set_code(s, 2))
                held.append(s)
                if len(held) >= 512:
                    _count(sketch, held)
            size = len(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(np.array(c, np.uint64).view(np.int64)), pa.array(np.array(c2, np.uint64).view(np.int64)), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], names)
        if held:
            _count(sketch, held)
        if kinds is not None:
            press = zstandard.ZstdCompressor(level=1)
            blobs = [press.compress(p.tobytes()) for p in np.split(sketch, PARTS)]
            yield pa.RecordBatch.from_arrays([pa.nulls(PARTS, kinds), *[pa.nulls(PARTS, pa.int64())] * 4, pa.array(range(PARTS), pa.int32()), pa.array(blobs, pa.binary())], names)

    return run, f"_id {kind}, _h long, n long, c long, c2 long, part int, blob binary"


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the sketches' pieces; holds one sum per piece, however many sketches there are."""
    import zstandard

    press, total = zstandard.ZstdDecompressor(), {}
    for b in batches:
        for part, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            x = np.frombuffer(press.decompress(blob.as_py()), np.uint32).astype(np.uint64)
            total[part] = total[part] + x if part in total else x
    up = zstandard.ZstdCompressor(level=1)
    rows = [(p, up.compress(x.tobytes())) for p, x in sorted(total.items())]
    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["part", "blob"])


def list_levels(sketches: DataFrame) -> np.ndarray:
    """How long each slot's lists are: 0 for lengths usual in a slot, then the doublings beyond."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    rows = sketches.repartition(PARTS, "part").mapInArrow(_added, "part int, blob binary").collect()  # fixed size: SLOTS counters
    count = np.zeros(SLOTS)
    for part, blob in rows:
        count[part * (SLOTS // PARTS) : (part + 1) * (SLOTS // PARTS)] = np.frombuffer(press.decompress(blob), np.uint64)
    return levels_of(count)


def levels_of(count: np.ndarray) -> np.ndarray:
    """Levels from the slots' counts. Lists share a slot with others, more the larger the input is, but what the others add
    differs little from slot to slot (a few square roots of the median): a list of some hundred sets stands out of a full sketch, too."""
    middle = float(np.median(count))
    usual = 4 * np.sqrt(middle) + LONG
    return np.where(count > middle + usual, np.ceil(np.log2(np.maximum((count - middle) / usual, 1.0))), 0).astype(np.uint8)


def ordered(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A set in the order common to all documents: short lists first."""
    level = levels[(s & core.U(len(levels) - 1)).astype(np.int64)]
    return s[np.lexsort((s, level))] if level.any() else s


def _short_lists(k: int, t: Fraction, levels):
    """(token, c, n, pos): the entries of each set in its shortest lists. Equal sets of one task go once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core.occupy("jaccard")
        level, seen = levels.value, set()
        for b in batches:
            raw, off = core.utf8(b.column(0))
            token, c, n, pos = [], [], [], []

            def out() -> pa.RecordBatch:
                size = [len(x) for x in token]
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), pa.array(np.repeat(np.array(c, np.uint64), size).view(np.int64)), pa.array(np.repeat(np.array(n, np.int32), size)), pa.array(np.concatenate(pos).astype(np.int32))], ["token", "c", "n", "pos"])

            for s in sets(raw, off, k):
                if len(s) < smallest(t) or (code := set_code(s, 1)) in seen:
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(code)
                p = len(s) - required(t, len(s)) + meetings(t)
                token.append(ordered(s, level)[:p])
                c.append(code)
                n.append(len(s))
                pos.append(np.arange(p))
                if len(token) >= 4096:
                    yield out()
                    token, c, n, pos = [], [], [], []
            if token:
                yield out()

    return run, "token long, c long, n int, pos int"


def _possible(t: Fraction, nx, ny, px, py):
    """Whether sets of nx and ny shingles can be alike, where one of their first meetings is at places px and py of their order."""
    need = (nx + ny) * t.numerator // (t.numerator + t.denominator)  # rounded down: never too strict
    return (np.minimum(nx, ny) * t.denominator >= np.maximum(nx, ny) * t.numerator) & (np.minimum(nx - px, ny - py) + meetings(t) - 1 >= need)


def _neighbours(t: Fraction, near: int):
    """Pairs of the ``near`` next entries of each list; rows come sorted by token, size, code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for b in batches:
            x = [b.column(i).to_numpy().astype(np.int64) for i in range(4)]
            if tail is not None:
                x = [np.concatenate(p) for p in zip(tail, x, strict=True)]
            token, c, n, pos = x
            old = len(tail[0]) if tail is not None else 0
            a, z = [], []
            for d in range(1, near + 1):
                if len(token) <= d:
                    break
                i = np.flatnonzero((token[d:] == token[:-d]) & (np.arange(d, len(token)) >= old))
                i = i[_possible(t, n[i], n[i + d], pos[i], pos[i + d])]
                a.append(np.minimum(c[i], c[i + d]))
                z.append(np.maximum(c[i], c[i + d]))
            tail = [v[-near:] for v in x]
            if a and sum(map(len, a)):
                pair, times = np.unique(np.stack([np.concatenate(a), np.concatenate(z)], 1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(times)], ["a", "b", "times"])

    return run, "a long, b long, times long"


def _verify(k: int, t: Fraction):
    """Rows (a, b, text) sorted by a: a's own text comes first (b null), then those of its candidates, which are searched
    for a. Alike pairs stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: tuple[int, np.ndarray] | None = None
        for b in core.slices(batches):
            left, right, who, held = [], [], [], []

            def search() -> None:
                if who:
                    left.extend([own[0]] * len(found := t_occurrence(own[1], held, t)))
                    right.extend(who[i] for i in found)
                who.clear()
                held.clear()

            for a, c, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), core.unsqueeze(b.column(2)), strict=True):
                if c is None:
                    search()
                    own = (a, _one(text, k))
                elif own is not None and own[0] == a:
                    who.append(c)
                    held.append(_one(text, k))
            search()
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run, "a long, b long"


def _one(text: bytes, k: int) -> np.ndarray:
    codes = [c for _, c, _ in core.batch_words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), lower=True)]
    return shingles(np.concatenate(codes), k)


def _linked(pairs: DataFrame, texts: DataFrame, k: int, t: Fraction, tag: str) -> DataFrame:
    """The alike ones of distinct staged pairs (a, b). Every text goes once to each a it is asked for; a list of asked
    texts that is short enough is broadcast, so that texts stay where they lie."""
    asked = pairs.select("a", F.col("b").alias("c"), "b").unionByName(pairs.select("a", F.col("a").alias("c"), F.lit(None).cast("long").alias("b")).distinct())
    few = pairs.count() <= LIGHT
    rows = texts.join(F.broadcast(asked) if few else asked, "c").select("a", "b", "_z")
    rows = rows.repartition("a").sortWithinPartitions("a", F.col("b").asc_nulls_first())
    return stage(rows.mapInArrow(*_verify(k, t)), tag)


def inverted(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inverted lists of some sets, one after another: shingles, where each one's list begins, and the members, ascending."""
    values = np.concatenate(held) if held else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(held)), [len(x) for x in held])
    by = np.argsort(values, kind="stable")
    values, owner = values[by], owner[by]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return values[first], np.append(first, len(values)), owner


def t_occurrence(x: np.ndarray, held: list[np.ndarray], t: Fraction, index: tuple | None = None) -> list[int]:
    """Which of some sets are alike to the query x, by DivideSkip. Of the query's inverted lists the longest, all but a few
    more than any partner may miss, are set aside; the short ones are merged into one ascending list of members (numpy's
    stable sort merges sorted runs; it does what a heap would), and a member that occurs in enough of them is looked up
    in the long lists by binary search until it reaches the overlap it needs or can't."""
    token, start, member = index if index is not None else inverted(held)
    if not len(token):
        return []
    at = np.minimum(np.searchsorted(token, x), len(token) - 1)
    at = at[token[at] == x]
    least = required(t, len(x))
    if len(at) < least:
        return []
    mine = [member[start[i] : start[i + 1]] for i in at[np.argsort(start[at + 1] - start[at], kind="stable")].tolist()]
    aside = max(0, least - meetings(t))
    short, long = mine[: len(mine) - aside], mine[len(mine) - aside :]
    if not short:
        return []
    merged = np.sort(np.concatenate(short), kind="stable")
    first = np.flatnonzero(np.concatenate(([True], merged[1:] != merged[:-1])))
    y, both = merged[first], np.diff(np.append(first, len(merged)))
    n = np.array([len(h) for h in held], np.int64)[y]
    need = -(-(len(x) + n) * t.numerator // (t.numerator + t.denominator))  # of alike sets of these sizes
    hope = (both + len(long) >= need) & (np.minimum(n, len(x)) * t.denominator >= np.maximum(n, len(x)) * t.numerator)
    y, both, need = y[hope], both[hope], need[hope]
    for k, p in enumerate(long):
        if not len(y):
            break
        both = both + (p[np.minimum(np.searchsorted(p, y), len(p) - 1)] == y)
        stays = both + len(long) - k - 1 >= need
        y, both, need = y[stays], both[stays], need[stays]
    return y[both >= need].tolist()


def _block_search(k: int, t: Fraction):
    """One pair of blocks: links between sets of different components, as many as join them."""

    def run(table: pa.Table) -> pa.Table:
        c, label, block = (table.column(x).to_numpy() for x in ("c", "l", "block"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        have = [_one(z, k) for z in core.unsqueeze(table.column("_z").combine_chunks())]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        held = [have[r] for r in right]
        index = inverted(held)
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while root.setdefault(v, v) != v:
                root[v] = v = root[root[v]]
            return v

        out = []
        for q in left:
            for r in t_occurrence(have[q], held, t, index) if held else []:
                a, b = find(int(label[q])), find(int(label[right[r]]))
                if a != b:
                    root[a] = b
                    out.append((min(int(c[q]), int(c[right[r]])), max(int(c[q]), int(c[right[r]]))))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run, "a long, b long"


def _crowds(crowd: DataFrame, labels: DataFrame, texts: DataFrame, k: int, t: Fraction) -> DataFrame:
    """Links inside crowds: members are dealt to blocks, every pair of blocks is one bounded task."""
    count = crowd.groupBy("crowd").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("blocks"))
    dealt = crowd.join(stage(count, "jaccard-crowds"), "crowd").join(labels, "c").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    each = dealt.select("crowd", "c", "l", "block", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("o"))
    pairs = stage(each.select("crowd", "c", "l", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j")), "jaccard-blocks")
    few = pairs.count() <= LIGHT  # the texts that nobody asks for stay where they are
    return texts.join(F.broadcast(pairs) if few else pairs, "c").groupBy("crowd", "i", "j").applyInArrow(*_block_search(k, t))


def _open(lists: DataFrame, group: DataFrame) -> DataFrame:
    """Lists with members of more than one component, each with its component ``l``."""
    labels = group.select(F.col("v").alias("c"), "l")
    known = lists.join(F.broadcast(labels) if labels.count() <= LIGHT else labels, "c", "left").withColumn("l", F.coalesce("l", "c"))
    token = W.partitionBy("token")
    apart = known.withColumns({"_a": F.min("l").over(token), "_b": F.max("l").over(token)}).where("_a <> _b")
    return stage(apart.select("token", "c", "n", "pos", "l"), "jaccard-open")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: Fraction = THRESHOLD) -> DataFrame:
    """One row per document: ``id_col, _h`` (the text's hash), ``n_shingles``, ``component_id`` (smallest id reachable),
    ``_l`` (the component's own label, null without words; components of null ids only differ in nothing else)."""
    base = core.documents(docs, id_col, text_col)
    kind = core.id_type(base)
    survey = stage(base.select("_id", "_t", "_h").mapInArrow(*_survey(words, kind)), "jaccard-sets")
    nodes = survey.where("part IS NULL").select("_id", "_h", "n", "c", "c2")
    if nodes.where("n > 0").groupBy("c").agg((F.min("c2") != F.max("c2")).alias("x")).where("x").limit(1).count():
        raise RuntimeError("two different sets have one 64-bit code")
    sc = docs.sparkSession.sparkContext
    levels = sc.broadcast(list_levels(survey.where("part IS NOT NULL").select("part", "blob")))
    entries = base.select("_t").mapInArrow(*_short_lists(words, threshold, levels)).repartition("token").dropDuplicates(["token", "c"])
    lists = stage(entries.withColumn("m", F.count(F.lit(1)).over(W.partitionBy("token"))).where("m > 1"), "jaccard-lists")
    rep = nodes.where("n > 0").groupBy("c").agg(F.min(F.struct("_id", "_h")).alias("r"))
    wanted = lists.select("c").distinct().join(rep, "c").select("c", F.col("r._id").alias("_i"), F.col("r._h").alias("_g"))
    texts = stage(
        core.squeezed(base, once=True).alias("d").join(wanted.alias("w"), F.col("d._id").eqNullSafe(F.col("w._i")) & (F.col("d._h") == F.col("w._g"))).select("w.c", "d._z"),
        "jaccard-texts",
    )
    first = stage(lists.repartition("token").sortWithinPartitions("token", "n", "c").select("token", "c", "n", "pos").mapInArrow(*_neighbours(threshold, NEAR)).groupBy("a", "b").agg(F.sum("times").alias("times")).where("times > 1").select("a", "b"), "jaccard-first")
    links = _linked(first, texts, words, threshold, "jaccard-links")
    group = components(links)
    tested = first
    open_ = _open(lists, group)
    for r in range(ROUNDS):
        # one member of each component of a list meets one of the next, in another order in every list and round
        one = open_.groupBy("token", "l").agg(F.min(F.struct(F.xxhash64("c", F.lit(r)).alias("h"), "c", "n", "pos")).alias("m"))
        one = one.select("token", "m.c", "m.n", "m.pos", F.xxhash64("l", "token", F.lit(r)).alias("o")).repartition("token").sortWithinPartitions("token", "o", "c").drop("o")
        pairs = stage(one.mapInArrow(*_neighbours(threshold, 1)).select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "jaccard-round")
        if not pairs.limit(1).count():
            break
        tested = tested.unionByName(pairs)
        more = _linked(pairs, texts, words, threshold, "jaccard-round-links")
        if not more.limit(1).count():
            break
        links = links.unionByName(more)
        group = components(links)
        open_ = _open(open_.drop("l"), group)
    # lists that are still long: their sets are searched in blocks, each set against all others of its crowd
    size = open_.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("hub"))
    crowded = stage(open_.join(size.where(F.col("m") > CROWD), "token").select("hub", "c", "l").distinct(), "jaccard-crowded")
    crowd = components(crowded.where("hub <> c"), "hub", "c").select(F.col("v").alias("c"), F.col("l").alias("crowd"))
    if crowded.limit(1).count():
        more = _crowds(crowd, crowded.select("c", "l").distinct(), texts, words, threshold)
        links = stage(links.unionByName(more), "jaccard-links")
        group = components(links)
        open_ = _open(open_.drop("l"), group)
    # every pair of a list whose sets are still apart and haven't met in a crowd: lists of CROWD sets at most, or of
    # several crowds and others
    open_ = stage(open_.join(F.broadcast(crowd) if crowd.count() <= LIGHT else crowd, "c", "left"), "jaccard-rest-lists")
    x, y = open_.alias("x"), open_.alias("y")
    num, den = threshold.numerator, threshold.denominator
    apart = (
        x.join(
            y,
            (F.col("x.token") == F.col("y.token")) & (F.col("x.l") != F.col("y.l")) & ~F.coalesce(F.col("x.crowd") == F.col("y.crowd"), F.lit(False))
            & ((F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.c") < F.col("y.c"))))
            & (F.col("x.n") * den >= F.col("y.n") * num)
            & (F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) + (meetings(threshold) - 1) >= F.floor((F.col("x.n") + F.col("y.n")) * num / (num + den))),
        )
        .groupBy(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= meetings(threshold)).select("a", "b")
    )
    apart = apart.join(tested, ["a", "b"], "left_anti")
    rest = _linked(stage(apart, "jaccard-apart"), texts, words, threshold, "jaccard-rest")
    if rest.limit(1).count():
        group = components(links.unionByName(rest))
    placed = nodes.where("n > 0").join(group.select(F.col("v").alias("c"), "l"), "c", "left").select("_id", "_h", "n", F.coalesce("l", "c").alias("l"))
    placed = stage(placed, "jaccard-placed")
    least = stage(placed.groupBy("l").agg(F.min("_id").alias("component_id")), "jaccard-least")
    out = placed.join(least, "l").select("_id", "_h", F.col("n").alias("n_shingles"), "component_id", F.col("l").alias("_l"))
    empty = nodes.where("n = 0").select("_id", "_h", F.col("n").alias("n_shingles"), F.col("_id").alias("component_id"), F.lit(None).cast("long").alias("_l"))
    return out.unionByName(empty).withColumnRenamed("_id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 3], ' ')) AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 3) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * k >= 85 * (nx.n + ny.n - k)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.y) AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN reach r ON w.doc_id = r.x GROUP BY ALL
"""

"""Jaccard join, line dedup and decontamination against plain loops."""

import random
from fractions import Fraction

import numpy as np

from florilege.llm import op3_line_dedup as op3
from florilege.llm import op8_decontamination as op8
from florilege.llm import op10_jaccard_join as op10
from florilege.llm.components import components
from tests.llm.fixtures import empty, table, texts


def shingle_set(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None) if sets[i] else d))
    return sorted(out, key=str)


def near_copies(n=60, seed=4):
    r = random.Random(seed)
    base = [f"t{k}" for k in range(120)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
        rows.append((100 + i, " ".join(w)))
    passage = " ".join(f"p{k}" for k in range(40))
    return rows + [(300 + i, passage + " " + " ".join(f"q{i}_{k}" for k in range(60))) for i in range(40)]


def test_jaccard_components(spark, monkeypatch):
    rows = texts() + near_copies()
    want = brute(rows)
    for crowd in (256, 4):  # 4: the search in blocks takes over
        monkeypatch.setattr(op10, "CROWD", crowd)
        monkeypatch.setattr(op10, "BLOCK", 16)
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in op10.jaccard_components(table(spark, rows)).collect()]
        assert sorted(got, key=str) == want
    assert op10.jaccard_components(empty(spark)).count() == 0


def test_t_occurrence():
    r = np.random.default_rng(5)
    t = Fraction(85, 100)
    base = np.unique(r.integers(0, 10**6, 80).astype(np.uint64))
    sets = [np.unique(np.concatenate([np.delete(base, r.integers(0, len(base), k)), r.integers(0, 10**6, k).astype(np.uint64)])) for k in (0, 1, 3, 6, 9, 14)]
    for x in sets:
        want = [i for i, y in enumerate(sets) if op10.alike(x, y, t)]
        assert sorted(op10.t_occurrence(x, sets, t)) == want
        assert op10.t_occurrence(x, [], t) == []
    for n in range(300):
        some = [np.unique(r.integers(0, 40, r.integers(1, 30)).astype(np.uint64)) for _ in range(8)]
        at = Fraction(int(r.integers(50, 100)), 100)
        assert sorted(op10.t_occurrence(some[0], some, at)) == [i for i, y in enumerate(some) if op10.alike(some[0], y, at)]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(20)] + [(30, 31), (32, 31), (40, 40)]
    for part in (1000, 3):  # 3: several tasks, then label rounds
        got = {r.v: r.l for r in components(spark.createDataFrame(pairs, "a long, b long"), part=part).collect()}
        assert got == {**dict.fromkeys(range(21), 0), 30: 30, 31: 30, 32: 30}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup(spark):
    long = "one two three four five six"
    rows = [(1, f"{long}\na\nb b\nc"), (2, "q\na\nb b\nw"), (3, long), (4, None), (5, ""), (6, f"{long} seven\n\n  {long} seven  "), (7, f"x\n{long} seven"), (8, "a"), (8, "a"), (None, "n n n n n n"), (9, "n n n n n n\nnew")]
    got = {(r.doc_id, r.text, r._lines, r._deleted) for r in op3.line_dedup(table(spark, rows)).collect()}
    assert got == {
        (1, f"{long}\na\nb b\nc", 4, 0), (2, "q\nw", 4, 2), (3, "", 1, 1), (4, None, 0, 0), (5, "", 0, 0), (6, f"{long} seven\n\n  {long} seven  ", 2, 0),
        (7, "x", 2, 1), (8, "a", 1, 0), (None, "n n n n n n", 1, 0), (9, "new", 2, 1)}
    df = op3.line_dedup(table(spark, rows))
    assert df.columns[:7] == table(spark).columns and df.count() == len(rows)
    assert op3.line_dedup(empty(spark)).count() == 0


def test_patience():
    pairs = [(0, 5), (1, 0), (2, 1), (3, 9), (4, 2)]
    assert op3.patience(pairs) == [1, 2, 4] and op3.patience([]) == []


def test_common_single_line_stays(spark):
    line = "a line that everyone has here"
    rows = [(i, f"{line}\nown {i} text of this one") for i in range(60)]
    assert sum(r._deleted for r in op3.line_dedup(table(spark, rows)).collect()) == 0
    assert sum(r._deleted for r in op3.line_dedup(table(spark, rows[:10])).collect()) == 9


def test_long_single_line_goes_from_any_number(spark):
    line = " ".join(f"word{k}" for k in range(60))
    rows = [(i, f"own {i} before\n{line}\nown {i} after") for i in range(60)]
    for part in (rows, rows[:10]):
        got = {r.doc_id: r.text for r in op3.line_dedup(table(spark, part)).collect()}
        assert got == {i: t if i == 0 else f"own {i} before\nown {i} after" for i, t in part}


def test_block_whose_lines_were_first_seen_apart(spark):
    verse, rare = ["the sea", "was calm", "at night"], [f"rare line number {k} of the first" for k in range(10)]
    rows = [(1, "\n".join(rare)), *((2 + i, f"x{i}\n{v}\ny{i}") for i, v in enumerate(verse)), (5, "\n".join(["b", *verse, "bb"])), (6, "\n".join([*rare, "d", *verse, "dd"]))]
    got = {r.doc_id: r.text for r in op3.line_dedup(table(spark, rows)).collect()}
    assert got == dict(rows) | {6: "d\ndd"}


def test_lines_in_a_row_without_their_counts(spark):
    # the second "a b" of the later document is the first one in a row
    rows = [(1, "a b\nq\nz"), (2, "c d\nr"), (3, "a b\nc d\ns"), (4, "a b\nt\na b\nc d\nu")]
    got = {r.doc_id: r.text for r in op3.line_dedup(table(spark, rows)).collect()}
    assert got == dict(rows) | {4: "a b\nt\nu"}


def hits(text, items, window=10):
    import re

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        u = words(t)
        for k in range(max(1, len(u) - window + 1)) if u else ():
            v = u[k : k + window]
            for i in range(len(w) - len(v) + 1):
                if w[i : i + len(v)] == v:
                    hit |= set(range(i, i + len(v)))
                    found.add(item)
    return len(w), len(hit), sorted(map(str, found))


def test_contamination(spark):
    items = [(1, "One two"), (10, "w1 w2, w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (2, None), (3, "..."), (10, "Éa b"), (4, "x y z")]
    rows = [(1, "ONE-two one two"), (2, "w0 W1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"), (3, "w1 w2 w3 w4 w5 w6 w7 w8 w9"), (4, None), (5, ""), (6, "éa b Éa b x y z"), (6, "éa b Éa b x y z"), (None, "x y z " * 5000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for budget in (op8.BUDGET, 16):  # 16: several automata
        got = sorted(((r.doc_id, r.n_words, sum(s.b - s.a for s in r.spans), [str(x) for x in r["items"]]) for r in op8.contamination(table(spark, rows), bench, budget=budget).collect()), key=str)
        assert got == sorted(((i, *hits(t, items)) for i, t in rows), key=str)
    clean = op8.clean(table(spark, rows), bench)
    assert clean.columns == table(spark).columns and sorted(r.doc_id for r in clean.collect()) == [3, 4, 5]
    assert op8.contamination(table(spark, rows), bench.limit(0)).where("size(spans) > 0").count() == 0
    assert op8.contamination(empty(spark), bench).count() == 0


def test_original_spans():
    text = "É, One-TWO three!"
    assert [text[a:b] for a, b in op8.original_spans(text.encode(), [(1, 3), (3, 4)])] == ["One-TWO", "three"]


def test_long_lists_stand_out_of_a_full_sketch():
    """A list of 200 sets in a sketch whose slots all hold about 250 of others is long: merged, it would make a crowd of its members."""
    count = np.random.default_rng(0).poisson(250, 1 << 16).astype(float)
    count[:50] += 200
    count[50:60] += 5000
    level = op10.levels_of(count)
    assert (level[:50] > 0).all() and (level[50:60] > level[:50].max()).all() and (level[60:] > 0).mean() < 0.001
    few = np.zeros(1 << 16)
    few[0] = 300
    assert op10.levels_of(few)[0] > 0 and not op10.levels_of(few)[1:].any()

"""Suffix-array and substring dedup against counting every window."""

import hashlib
import random
from collections import Counter

import pytest

from florilege.llm import op4_suffix_dedup as op4
from florilege.llm import op5_substring_dedup as op5
from tests.llm.fixtures import empty, table, texts


def covered(units, n, size):
    """Which of n places lie in a window of ``size`` that recurs; units: per text a sequence."""
    count = Counter(tuple(u[i : i + size]) for u in units for i in range(len(u) - size + 1))
    out = []
    for u in units:
        c = bytearray(len(u))
        for i in range(len(u) - size + 1):
            if count[tuple(u[i : i + size])] > 1:
                c[i : i + size] = b"\1" * size
        out.append(c)
    return out


@pytest.mark.parametrize(("length", "part"), [(40, op4.PART), (40, 1), (200, op4.PART)])
def test_suffix_dedup(spark, length, part):
    rows = [(i, t if t is None or len(t) < 20000 else t[:4000]) for i, t in texts()]
    units = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (i, _), u, c in zip(rows, units, covered(units, None, length), strict=True):
        want[(i, len(u), hashlib.sha256(bytes(x for x, y in zip(u, c, strict=True) if not y)).hexdigest())] += 1
    got = Counter((r.doc_id, r.n_bytes, hashlib.sha256(r.kept).hexdigest()) for r in op4.suffix_dedup(table(spark, rows), length=length, part=part).collect())
    assert got == want


@pytest.mark.parametrize("window", [5, 35])
def test_substring_dedup(spark, window):
    rows = [(i, t if t is None or len(t) < 20000 else t[:8000]) for i, t in texts()]
    units = [(t or "").split() for _, t in rows]
    want = Counter()
    for (i, _), u, c in zip(rows, units, covered(units, None, window), strict=True):
        want[(i, len(u), " ".join(x for x, y in zip(u, c, strict=True) if not y))] += 1
    got = Counter((r.doc_id, r.n_words, r.kept) for r in op5.substring_dedup(table(spark, rows), window=window).collect())
    assert got == want


def recurring(units, size):
    """As ``covered``, by sorting, for long texts."""
    at = {}
    for k, u in enumerate(units):
        for i in range(len(u) - size + 1):
            at.setdefault(hash(tuple(u[i : i + size]) if isinstance(u, list) else u[i : i + size]), []).append((k, i))
    out = [bytearray(len(u)) for u in units]
    for places in at.values():
        if len(places) > 1:
            for k, i in places:
                out[k][i : i + size] = b"\1" * size
    return out


def seam_rows():
    """Texts beyond a block, whose repeats lie at other places relative to the blocks' seams."""
    r = random.Random(8)
    long = " ".join(f"w{r.randrange(10**5)}" for _ in range(60000))
    cut = long[250_000:270_000]
    rows = [(1, long), (2, "x " * 777 + cut + " end"), (3, long[100:400] * 3), (4, "own words " + long[-900:])]
    return rows + [(10 + i, f"doc {i} " + " ".join(f"u{r.randrange(10**6)}" for _ in range(30)) + " " + long[5000:5400] + f" tail {r.randrange(10**6)} " * 40) for i in range(30)]


def test_long_texts_and_seams(spark):
    """Uncut long texts: what lies across the seams of blocks is found."""
    from florilege.llm import core

    rows = seam_rows()
    assert len(rows[0][1]) > core.BLOCK
    units = [t.encode() for _, t in rows]
    want = {i: bytes(x for x, y in zip(u, c, strict=True) if not y) for (i, _), u, c in zip(rows, units, recurring(units, 200), strict=True)}
    for part in (op4.PART, 4):
        assert {r.doc_id: bytes(r.kept) for r in op4.suffix_dedup(table(spark, rows), part=part).collect()} == want
    units = [t.split() for _, t in rows]
    want = {i: " ".join(x for x, y in zip(u, c, strict=True) if not y) for (i, _), u, c in zip(rows, units, recurring(units, 35), strict=True)}
    assert {r.doc_id: r.kept for r in op5.substring_dedup(table(spark, rows)).collect()} == want


def test_previous_factor():
    """The array against a plain scan, and its sources."""
    import numpy as np

    from florilege.llm.suffix import previous_factor

    r = random.Random(1)
    for _ in range(120):
        texts_ = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 40))) for _ in range(r.randint(1, 6))]
        cap = r.choice([1, 2, 3, 4, 5, 8, 9, 12, 16, 20])
        off = np.concatenate(([0], np.cumsum([len(t) for t in texts_])))
        joint = b"".join(texts_)
        length, source = previous_factor(np.frombuffer(joint, np.uint8), off, cap)
        first = {}
        for k, t in enumerate(texts_):
            for i in range(len(t) - cap + 1):
                w, p = t[i : i + cap], int(off[k]) + i
                assert (length[p] >= cap) == (w in first)
                assert w not in first or (source[p] < p and joint[source[p] : source[p] + cap] == w)
                first.setdefault(w, p)


def test_empty(spark):
    assert op4.suffix_dedup(empty(spark)).count() == 0 and op5.substring_dedup(empty(spark)).count() == 0

"""Hash primitives, winnowing and suffix arrays against plain loops."""

import numpy as np
import pytest

from florilege.llm import core
from florilege.llm.op1_packing import CapacityTree, plan
from florilege.llm.suffix import PACKED, previous_factor, previous_smaller


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 12, 13, 32])
def test_grams(k):
    e = core.mix(np.arange(50, dtype=np.uint64))
    want = []
    for i in range(len(e) - k + 1):
        h = 0
        for j in range(k):
            h = (h * int(core.BASE) + int(e[i + j])) % (1 << 64)
        want.append(h)
    assert core.grams(e, k).tolist() == want


@pytest.mark.parametrize("q", [1, 2, 3, 7, 8])
def test_sliding_min(q):
    x = np.random.default_rng(0).integers(0, 9, 60)
    assert core.sliding_min(x, q).tolist() == [int(x[i : i + q].min()) for i in range(60 - q + 1)]


def test_winnow_covers_each_window_once_and_alike():
    r = np.random.default_rng(1)
    e = core.mix(r.integers(0, 3, 400).astype(np.uint64))
    starts, ends = np.array([0, 150, 155]), np.array([150, 155, 400])
    w = core.winnow(e, starts, ends, 20, 6)
    seen, by = [], {}
    for lo, n, rel, a in zip(w["lo"].tolist(), w["n"].tolist(), w["rel"].tolist(), w["anchor"].tolist(), strict=True):
        for i in range(n):
            seen.append(lo + i)
            by.setdefault(e[lo + i : lo + i + 20].tobytes(), set()).add((a, rel - i))
    assert sorted(seen) == [i for s, t in ((0, 150), (155, 400)) for i in range(s, t - 19)]
    assert all(len(x) == 1 for x in by.values())


def test_lpf_against_brute_force():
    r = np.random.default_rng(2)
    for cap in (3, 7, 16, 50):
        s = r.integers(0, 2, 160).astype(np.uint8)
        n = len(s)
        widths = [1]
        while widths[-1] * 2 <= min(cap, PACKED):
            widths = [widths[-1] * 2]
        while widths[-1] < cap:
            widths.append(min(cap, widths[-1] * 2))

        def lcp(i, j, s=s, cap=cap):
            k = 0
            while k < cap and max(i, j) + k < len(s) and s[i + k] == s[j + k]:
                k += 1
            return k

        best = [max((lcp(i, j) for j in range(i)), default=0) if n - i >= cap else 0 for i in range(n)]
        length, source = previous_factor(s, np.array([0, n]), cap)
        assert length.tolist() == [max((w for w in widths if w <= x), default=0) for x in best]
        for i in np.flatnonzero(length).tolist():
            assert source[i] < i and lcp(i, int(source[i])) >= length[i]


def test_previous_smaller():
    x = np.array([3, 1, 2, 5, 4])
    at, least = previous_smaller(x, np.array([0, 9, 7, 6, 8]))
    assert at.tolist() == [-1, -1, 1, 2, 2] and least.tolist() == [0, 0, 7, 6, 6]


def test_capacity_tree():
    t = CapacityTree(10)
    assert t.tightest(1) == -1
    t.put(3, 0, 2)
    t.put(10, 2, 1)
    assert (t.tightest(1), t.tightest(3), t.tightest(4), t.tightest(10)) == (3, 3, 10, 10)
    t.take(3)
    assert t.tightest(1) == 10


def test_plan_is_best_fit_decreasing():
    import bisect

    r = np.random.default_rng(3)
    for limit in (10, 64):
        sizes = r.integers(1, limit + 1, 300).tolist()
        free, bins = [], 0
        for s in sorted(sizes, reverse=True):
            j = bisect.bisect_left(free, s)
            if j < len(free):
                room = free.pop(j)
            else:
                room, bins = limit, bins + 1
            if room - s:
                bisect.insort(free, room - s)
        counts = {s: sizes.count(s) for s in set(sizes)}
        rows = plan(counts, limit)
        used = {}
        for s, n in counts.items():
            mine = rows[rows[:, 0] == s]
            for rank in range(n):
                _, r0, b0, per, off = mine[np.searchsorted(mine[:, 1], rank, "right") - 1]
                k = rank - r0
                used.setdefault(int(b0 + k // per), []).append((int(off + (k % per) * s), s))
        assert len(used) == bins
        for places in used.values():
            at = 0
            for off, s in sorted(places):
                assert off == at
                at += s
            assert at <= limit

"""Suffix order and longest-previous-factor arrays, in numpy."""

from __future__ import annotations

import numpy as np

PACKED = 4  # bytes that the first sort compares as one number; a position fits beside them


def _packed(raw: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes from each position on as one number; the first byte weighs most."""
    out = raw.astype(np.uint64)
    have = 1
    while have < width:  # widths are powers of two
        m = len(out) - have
        out = (out[:m] << np.uint64(8 * have)) | out[have : have + m]
        have *= 2
    return out


def _sorted(high: np.ndarray, low: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``at`` and their keys (high, low), in order of the keys. Where key and position fit into 64 bits they
    are sorted as one number, which is several times as fast as sorting indices."""
    key = (high.astype(np.uint64) << np.uint64(bits)) | low.astype(np.uint64)
    if 3 * bits <= 64:
        both = np.sort((key << np.uint64(bits)) | at.astype(np.uint64))
        return (both & np.uint64((1 << bits) - 1)).astype(np.int64), both >> np.uint64(bits)
    by = np.argsort(key)
    return at[by], key[by]


def levels_of(raw: np.ndarray, off: np.ndarray, cap: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Order of the suffixes of the texts raw[off[i]:off[i+1]] by prefix doubling, compared on ``cap`` bytes at most, and
    rank arrays per compared width. A rank says how many suffixes are smaller; equal ranks mean equal bytes. Widths
    never reach beyond a text: a rank holds for positions with at least that many bytes left, and the order
    (returned first) is that of the positions with ``cap`` bytes left."""
    n = len(raw)
    left = np.repeat(off[1:] - off[0], np.diff(off)) - np.arange(n)
    width = 1
    while width * 2 <= min(cap, PACKED):
        width *= 2
    at = np.flatnonzero(left >= width)
    key = _packed(raw, width)[at] if len(at) else np.zeros(0, np.uint64)
    rank = np.zeros(n, np.int64)
    bits = max(1, int(n).bit_length())
    both = np.sort((key << np.uint64(32)) | at.astype(np.uint64))  # a batch has far less than 2**32 bytes
    at, key = (both & np.uint64((1 << 32) - 1)).astype(np.int64), both >> np.uint64(32)  # groups of equal keys side by side
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(key)))
    rank[at] = np.repeat(start, size)
    levels = [(width, rank.astype(np.int32))]
    open_ = at[np.repeat(size > 1, size)]
    while width < cap:
        step = min(width, cap - width)  # the last width overlaps
        width += step
        open_ = open_[left[open_] >= width]
        if len(open_):
            at, key = _sorted(rank[open_], rank[open_ + step], open_, bits)
            new = np.concatenate(([True], key[1:] != key[:-1]))
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(at)))
            old = rank[at[start]]
            first = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1])))
            base = np.repeat(start[first], np.diff(np.append(first, len(start))))
            rank[at] = np.repeat(old + start - base, size)  # the group's rank and how many of the group are smaller
            open_ = at[np.repeat(size > 1, size)]
        levels.append((width, rank.astype(np.int32)))
    starts = np.flatnonzero(left >= cap)
    return _sorted(np.zeros(len(starts), np.int64), rank[starts], starts, bits)[0], levels


def previous_smaller(x: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the closest j < i with x[j] < x[i] (or -1), and the least of common[j+1..i], by pointer jumping."""
    n = len(x)
    j = np.arange(-1, n - 1)
    least = common.copy()
    todo = np.flatnonzero(j >= 0)
    todo = todo[x[j[todo]] > x[todo]]
    while len(todo):
        least[todo], j[todo] = np.minimum(least[todo], least[j[todo]]), j[j[todo]]
        todo = todo[(j[todo] >= 0) & (least[todo] > 0)]  # beyond no common byte nothing can match
        todo = todo[x[j[todo]] > x[todo]]
    return j, np.where(j >= 0, least, 0)


def previous_factor(raw: np.ndarray, off: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """LPF: for each position the longest match that starts earlier, and where that starts (-1: none), both 0 and -1 where
    fewer than ``cap`` bytes are left. Lengths are the compared width on which both agree: 0, a power of two, or
    ``cap``, which is exact. In suffix order the best earlier match of a position is the previous or the next
    suffix that starts before it."""
    n = len(raw)
    length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    if not n:
        return length, source
    sa, levels = levels_of(raw, off, cap)
    if not len(sa):
        return length, source
    common = np.zeros(len(sa), np.int64)  # of each suffix with the one before it in order
    alike = np.arange(1, len(sa))
    for width, rank in levels:
        alike = alike[rank[sa[alike]] == rank[sa[alike - 1]]]
        common[alike] = width
    before, with_before = previous_smaller(sa, common)
    back = np.concatenate(([0], common[:0:-1]))
    after, with_after = previous_smaller(sa[::-1], back)
    after, with_after = np.where(after >= 0, len(sa) - 1 - after, -1)[::-1], with_after[::-1]
    near = np.where(with_before >= with_after, before, after)
    length[sa] = np.maximum(with_before, with_after)
    source[sa] = np.where(length[sa] > 0, sa[near], -1)
    return length, source

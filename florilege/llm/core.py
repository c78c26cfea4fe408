"""What the training-data operators share: inputs, text blocks, rolling hashes, winnowing.

Every operator first reduces its input to two columns, ``_id`` and ``_t``, so extra
columns with any name pass by without a clash. A document is identified by its id
*and* the hash of its text (``_h``): repeated rows and null ids then stay well defined.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    # Arrays of a megabyte or more go back to the system when they are freed (M_MMAP_THRESHOLD, which by default
    # grows with use): Python workers idle beside the JVM, and what they hold counts as the executor's.
    ctypes.CDLL(None).mallopt(-3, 1 << 20)
    pa.set_memory_pool(pa.system_memory_pool())
except (AttributeError, OSError):  # another C library
    pass

_tenant: list = ["", None]


def occupy(name: str, forget=None) -> None:
    """A worker process serves one operator after another, but its long-lived memory has one tenant: what the last
    operator remembers from task to task (``forget`` drops it) goes when another one begins."""
    if _tenant[0] != name:
        if _tenant[1] is not None:
            _tenant[1]()
        _tenant[:] = [name, forget]
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass


U = np.uint64
BASE = U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INVERSE = U(pow(int(BASE), -1, 1 << 64))
BLOCK = 1 << 18  # elements hashed at once; bounds a worker's memory
_POS = U((1 << 28) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), vectorised."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_CODE = mix((np.arange(256, dtype=np.uint64) + U(1)) * U(0xD1342543DE82EF95))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, kept for later calls."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, b in (("up", BASE), ("down", INVERSE)):
            a = np.full(size, b, dtype=np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"][:n]


def prefix(e: np.ndarray) -> np.ndarray:
    """Prefix sums of e[i] * BASE**i, one longer than e."""
    out = np.zeros(len(e) + 1, dtype=np.uint64)
    np.cumsum(e * powers(len(e))[0], out=out[1:])
    return out


def between(p: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Polynomial hashes of e[lo:hi] for each pair, from prefix sums."""
    return (p[hi] - p[lo]) * powers(len(p))[1][lo]


def grams(e: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of each k consecutive elements, by doubling."""
    have, width, out, done = e, 1, None, 0
    step = BASE
    while True:
        if k & width:
            if out is None:
                out, done = have, width
            else:  # the parts collected so far come first
                n = len(e) - done - width + 1
                out = out[:n] * U(pow(int(BASE), width, 1 << 64)) + have[done : done + n]
                done += width
        if done == k:
            return out
        n = len(have) - width
        have = have[:n] * step + have[width : width + n]
        width *= 2
        step = U(pow(int(BASE), width, 1 << 64))


def sliding_min(x: np.ndarray, q: int) -> np.ndarray:
    size = 1
    while size * 2 <= q:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (q - size)], x[q - size :]) if q > size else x


def winnow(e: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, k: int) -> dict[str, np.ndarray]:
    """Deal every window of ``window`` elements to the smallest k-gram hash inside it.

    Pieces are e[starts[i]:ends[i]], disjoint and ascending. Equal windows pick the same
    gram at the same place, so a window can only recur where its gram (the anchor) recurs.
    Consecutive windows with one anchor occurrence form a run: ``piece``, ``lo`` (first
    window start, absolute), ``n`` windows, ``rel`` (anchor - lo), ``anchor`` and ``ctx``
    (hash of everything the run's windows cover, with n and rel).
    """
    names = ("piece", "lo", "n", "rel", "anchor", "ctx")
    fits = ends - starts >= window
    if len(e) < window or not fits.any():
        return {x: np.zeros(0, dtype=np.uint64 if x in ("anchor", "ctx") else np.int64) for x in names}
    h = mix(grams(e, k))
    key = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    pick = (sliding_min(key, window - k + 1) & _POS).astype(np.int64)
    edge = np.zeros(len(pick) + 1, dtype=np.int64)
    np.add.at(edge, starts[fits], 1)
    np.add.at(edge, ends[fits] - window + 1, -1)
    at = np.flatnonzero(np.cumsum(edge[:-1]))
    pos = pick[at]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(pos) != 0) | (np.diff(at) != 1))))
    n = np.diff(np.append(first, len(at)))
    lo, p = at[first], pos[first]
    sums = prefix(e)
    ctx = mix(between(sums, lo, lo + n - 1 + window) ^ mix((n.astype(np.uint64) << U(32)) | (p - lo).astype(np.uint64)))
    return {"piece": np.searchsorted(starts, lo, "right") - 1, "lo": lo, "n": n, "rel": p - lo, "anchor": h[p], "ctx": ctx}


def collapse(r: dict[str, np.ndarray], salt: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of one block with their weight ``w``: of equal runs the first stays, with weight 2, and all windows of
    such runs come as spans of weight 0, neighbours joined, each under an anchor of its own. A passage
    that is repeated within a text or a block so costs a few rows, however often it is.
    ``salt``: a hash of each piece."""
    n = len(r["lo"])
    if not n:
        return r | {"w": np.zeros(0, np.int32)}
    key = mix(r["anchor"] ^ mix(r["ctx"]))
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    size = np.diff(np.append(np.flatnonzero(new), n))
    many = np.empty(n, bool)
    many[order] = np.repeat(size > 1, size)
    first = np.zeros(n, bool)
    first[order[new]] = True
    keep = np.flatnonzero(~many | first)
    out = {k: v[keep] for k, v in r.items()} | {"w": np.where(many[keep], 2, 1).astype(np.int32)}
    again = np.flatnonzero(many)
    if len(again):
        lo, end, piece = r["lo"][again], (r["lo"] + r["n"])[again], r["piece"][again]
        start = np.flatnonzero(np.concatenate(([True], (lo[1:] != end[:-1]) | (piece[1:] != piece[:-1]))))
        stop = np.append(start[1:], len(again)) - 1
        zero = np.zeros(len(start), np.int64)
        more = {"piece": piece[start], "lo": lo[start], "n": end[stop] - lo[start], "rel": zero, "anchor": mix(salt[piece[start]] ^ mix(lo[start].astype(np.uint64))), "ctx": zero.astype(np.uint64), "w": zero.astype(np.int32)}
        out = {k: np.concatenate([out[k], more[k]]) for k in out}
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the n + 1 offsets of a string or binary column, without a copy (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def slices(batches: Iterator[pa.RecordBatch], most: int = 128) -> Iterator[pa.RecordBatch]:
    """Batches of ``most`` rows at most, where each row may unpack to a whole text."""
    for b in batches:
        for at in range(0, b.num_rows, most):
            yield b.slice(at, most)


def blocks(sizes: np.ndarray, overlap: int, most: int = BLOCK) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of pieces (document, from, to), each list of about ``most`` elements at the most.
    A document longer than that is cut into pieces which overlap by ``overlap`` elements."""
    out, held = [], 0
    for i, size in enumerate(sizes.tolist()):
        at = 0
        while True:
            to = min(size, at + most + overlap)
            if held and held + to - at > most:
                yield out
                out, held = [], 0
            out.append((i, at, to))
            held += to - at
            if to == size:
                break
            at += most
    if out:
        yield out


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words (runs without ASCII white space) of one block."""
    ink = ~IS_SPACE[raw]
    flip = np.diff(np.concatenate(([False], ink, [False])).astype(np.int8))
    return np.flatnonzero(flip == 1), np.flatnonzero(flip == -1)


def word_codes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit code of each word."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    return mix(between(prefix(BYTE_CODE[raw]), starts, ends) ^ mix((ends - starts).astype(np.uint64)))


def block_words(raw: np.ndarray, off: np.ndarray, docs: range, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word codes of the documents ``docs`` and their word offsets. The blocks are whole documents;
    a document beyond BLOCK bytes is coded piecewise, cut at white space."""
    codes, counts = [], []
    for i in docs:
        text = raw[off[i] : off[i + 1]]
        got = 0
        at = 0
        while at < len(text):
            to = min(len(text), at + BLOCK)
            if to < len(text):
                gap = np.flatnonzero(IS_SPACE[text[at:to]])
                while not len(gap) and to < len(text):  # a word longer than a block stays whole
                    to = min(len(text), to + BLOCK)
                    gap = np.flatnonzero(IS_SPACE[text[at:to]])
                to = at + int(gap[-1]) + 1 if len(gap) and to < len(text) else to
            part = LOWER[text[at:to]] if lower else text[at:to]
            c = word_codes(part, *words_of(part))
            codes.append(c)
            got += len(c)
            at = to
        counts.append(got)
    return (np.concatenate(codes) if codes else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(counts, dtype=np.int64))).astype(np.int64)


def batch_words(raw: np.ndarray, off: np.ndarray, lower: bool = False) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """Groups of documents of about BLOCK bytes: which, word codes, word offsets. Documents of usual
    length are coded together in one sweep."""
    n, at = len(off) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + BLOCK, "right")) - 1)
        docs = range(at, to)
        if to - at == 1 and off[to] - off[at] > BLOCK:
            yield docs, *block_words(raw, off, docs, lower)
        else:
            # a space between documents keeps their words apart
            size = off[at + 1 : to + 1] - off[at:to]
            joint = np.full(int(size.sum()) + len(size), 0x20, dtype=np.uint8)
            start = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
            take = np.ones(len(joint), bool)
            take[start + size] = False
            body = raw[off[at] : off[to]]
            joint[take] = LOWER[body] if lower else body
            s, e = words_of(joint)
            yield docs, word_codes(joint, s, e), np.append(np.searchsorted(s, start), len(s)).astype(np.int64)
        at = to


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id``, ``_t`` and ``_h`` (the text's hash) of a table with any other columns."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("_id"), text.alias("_t"), F.xxhash64(text).alias("_h"))


def same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    """Null-safe equality on some columns."""
    out = F.lit(True)
    for x in names:
        out = out & a[x].eqNullSafe(b[x])
    return out


def id_type(docs: DataFrame, id_col: str = "_id") -> str:
    return docs.schema[id_col].dataType.simpleString()


def squeezed(base: DataFrame, once: bool = False) -> DataFrame:
    """``_id, _h, _z``: the text as a zstd frame. Text that has to cross a shuffle for a join goes
    at about half its size. ``once``: of a task's repeated rows one goes (of those of different tasks one each)."""
    kind = id_type(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1, write_checksum=False)
        seen: set = set()
        for b in batches:
            if once:
                seen = seen if len(seen) < 1_000_000 else set()
                keys = list(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True))
                new = [i for i, x in enumerate(keys) if x not in seen and not seen.add(x)]
                b = b if len(new) == len(keys) else b.take(pa.array(new, pa.int64()))
            raw, off = utf8(b.column(1))
            z = [press.compress(raw[off[i] : off[i + 1]].tobytes()) for i in range(len(off) - 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(z, pa.binary())], ["_id", "_h", "_z"])

    return base.select("_id", "_t", "_h").mapInArrow(run, f"_id {kind}, _h bigint, _z binary")


def unsqueeze(column: pa.Array) -> Iterator[bytes]:
    import zstandard

    press = zstandard.ZstdDecompressor()
    for z in column:
        yield press.decompress(z.as_py()) if z.is_valid else b""

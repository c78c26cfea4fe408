"""Best-fit packing of tokenized documents into sequences.

Method: best-fit decreasing with a segment tree over remaining capacities. The tree is indexed by
capacity, so the tightest open bin is found in log(limit) steps whatever the number of bins; equal
pieces are placed together, which gives the very bins that one-by-one best-fit decreasing gives.
The plan needs only how many pieces have each length (at most ``limit`` numbers), so it runs on
the driver at any input size; pieces then look up their place by their rank among equals. The
ranking is salted, as one length may hold a third of all pieces.

Edge cases: null text counts as empty and still yields one piece holding the end mark; repeated
rows are packed as often as they occur; null ids are kept; an empty table gives no rows. Texts of any
length are tokenized whole and cut only past ``limit`` ids. Pieces of equal length (ties) take equal places in the order of their
ranks, which changes no bin's load; columns other than id and text don't enter, whatever their names.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from florilege.llm import core
from florilege.session import stage

LIMIT = 2048
END_ID = 0
SALTS = 256
PART = 1 << 21  # bytes of text parted into words at once
KNOWN = 500_000  # words whose ids a worker remembers
_GAPS = bytes(0x20 if c in (0x09, 0x0A, 0x0D) else c for c in range(256))


class CapacityTree:
    """A segment tree over capacities 0..limit; a leaf holds the open bins with that much room as
    ranges (first bin, how many), an inner node whether any leaf below is taken."""

    def __init__(self, limit: int):
        self.size = 1 << limit.bit_length()
        self.any = [False] * (2 * self.size)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(limit + 1)]

    def put(self, room: int, first: int, count: int) -> None:
        if count:
            self.bins[room].append((first, count))
            i = room + self.size
            while i and not self.any[i]:
                self.any[i] = True
                i //= 2

    def take(self, room: int) -> tuple[int, int]:
        out = self.bins[room].pop()
        if not self.bins[room]:
            i = room + self.size
            self.any[i] = False
            while i > 1:
                i //= 2
                self.any[i] = self.any[2 * i] or self.any[2 * i + 1]
        return out

    def tightest(self, need: int) -> int:
        """The smallest capacity >= need with an open bin, or -1."""
        i = need + self.size
        if self.any[i]:
            return need
        while i > 1:  # up to the first subtree on the right that is taken, then down its left edge
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return -1


def plan(counts: dict[int, int], limit: int) -> np.ndarray:
    """Best-fit decreasing for ``counts`` pieces of each length. Rows (length, first rank, first bin,
    pieces per bin, offset in the bin), ascending by length and rank: the piece of that length with
    rank r goes to bin first_bin + (r - first_rank) // per_bin."""
    tree, rows, opened = CapacityTree(limit), [], 0
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            room = tree.tightest(size)
            if room < 0:
                room, (first, count) = limit, (opened, -(-left // (limit // size)))
                opened += count
            else:
                first, count = tree.take(room)
            per = room // size
            full = min(count, left // per)
            rest = left - full * per if full < count else 0
            rest = min(rest, per - 1) if full < count else 0
            rows.append((size, rank, first, per, limit - room))
            placed = full * per + rest
            tree.put(room - per * size, first, full)
            if rest:
                tree.put(room - rest * size, first + full, 1)
            tree.put(room, first + full + bool(rest), count - full - bool(rest))
            rank += placed
            left -= placed
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


_PLAIN = np.frombuffer(bytes(0x20 if c in (0x09, 0x0A, 0x0D) else c + 32 if 65 <= c <= 90 else c for c in range(256)), np.uint8)
_MARK = np.zeros(256, bool)
_MARK[list(b"%$#*&!.,|")] = True
_SOLID = np.zeros(256, bool)
_SOLID[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True


def parted(raw: np.ndarray, off: np.ndarray) -> list[list[bytes]]:
    """The texts raw[off[i]:off[i + 1]] as lists of words that can be tokenized one by one.

    White space always parts pre-tokens, and so does the seam between an ASCII letter or digit and a final
    run of common marks. Case is dropped, of ASCII letters here and of others by the tokenizer - unless
    that could make a special token out of ordinary text."""
    body = raw[off[0] : off[-1]]
    at = off - off[0]
    if b"<|" in body.tobytes():
        flat = body.tobytes().translate(_GAPS)
    else:
        low = _PLAIN[body]
        step = np.diff(np.concatenate(([0], _MARK[low].view(np.int8), [0])))
        s, e = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        s = s[(np.append(low, 0x20)[e] == 0x20) & (s > 0) & _SOLID[low[s - 1]]] if len(s) else s
        flat = np.insert(low, s, 0x20).tobytes()
        at = at + np.searchsorted(s, at)
    at = at.tolist()
    return [flat[a:b].split(b" ") for a, b in zip(at, at[1:], strict=False)]


class WordIds:
    """Ids of words (as bytes) under a word-level BPE tokenizer, remembered.

    A word of letters alone is one pre-token; a list of such is encoded in one call and parted where a
    word-end token stands."""

    def __init__(self, model):
        self.encode = model.encode_batch_fast
        vocabulary = model.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {b"": b""}

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        new = list(words.difference(self.words))
        if len(self.words) + len(new) > KNOWN:
            self.words = {b"": b""}
            new = list(words.difference(self.words))
        if new:
            text = b" ".join(new).decode("utf-8").split(" ")
            letters = [i for i, ok in enumerate(map(str.isalpha, text)) if ok]
            for at in range(0, len(letters), 20_000):
                part = letters[at : at + 20_000]
                self._one_each([new[i] for i in part], [text[i] for i in part])
            rest = set(range(len(new))).difference(letters)
            self._each([new[i] for i in rest], [text[i] for i in rest])
        return self.words

    def _each(self, words: list[bytes], text: list[str]) -> None:
        for at in range(0, len(words), 10_000):
            for x, e in zip(words[at : at + 10_000], self.encode(text[at : at + 10_000], add_special_tokens=False), strict=True):
                self.words[x] = np.array(e.ids, "<u4").tobytes()

    def _one_each(self, words: list[bytes], text: list[str]) -> None:
        ids = np.array(self.encode([" ".join(text)], add_special_tokens=False)[0].ids, "<u4")
        stop = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        if len(stop) != len(words):  # some letter's lower case holds a mark, which parts the word
            return self._each(words, text)
        flat = ids.tobytes()
        self.words.update(zip(words, map(flat.__getitem__, map(slice, [0, *stop[:-1]], stop)), strict=True))


@cache
def word_ids(path: str) -> WordIds:
    """One memory of words per worker process and tokenizer, kept from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return WordIds(Tokenizer.from_file(path))


def _pieces(tokenizer: str, limit: int, end_id: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core.occupy("packing", word_ids.cache_clear)
        ids_of = word_ids(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            raw, off = core.utf8(b.column(1))
            n = len(off) - 1
            at = 0
            while at < n:
                to = max(at + 1, int(np.searchsorted(off, off[at] + PART, "right")) - 1)
                split = parted(raw, off[at : to + 1])
                known = ids_of.learn(set().union(*split))
                who, piece, start, length, crc = [], [], [], [], []
                for i, words in enumerate(split, at):
                    ids = b"".join(map(known.__getitem__, words)) + end
                    total = len(ids) // 4
                    for k in range(0, total, limit):
                        part = ids[4 * k : 4 * (k + limit)]
                        who.append(i)
                        piece.append(k // limit)
                        start.append(k)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["_id", "piece", "start", "length", "ids_crc32"])
                at = to

    return run, f"_id {kind}, piece int, start long, length long, ids_crc32 long"


def place(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to any table of pieces with a column ``length`` (1 to limit) and
    ``_order`` (what equal pieces are ordered by). The table is read twice; stage it first."""
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("_order"), F.lit(SALTS)).cast("int"))
    # at most limit * SALTS rows: how many pieces of that length stand before each salt
    sums = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = sums.select("length", "_salt", "_n", (F.sum("_n").over(W.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    before = stage(before, "pack-ranks")
    counts = {r[0]: r[1] for r in before.groupBy("length").agg(F.sum("_n")).collect()}
    slots = plan(counts, limit)
    ranked = salted.withColumn("_r", F.row_number().over(W.partitionBy("length", "_salt").orderBy("_order")) - 1).join(F.broadcast(before.select("length", "_salt", "_before")), ["length", "_salt"])
    first = np.searchsorted(slots[:, 0], np.arange(limit + 2))
    step = int(slots[:, 1].max()) + 1 if len(slots) else 1
    keys = slots[:, 0] * step + slots[:, 1]
    keep = [c for c in pieces.columns if c != "_order"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column(b.num_columns - 2).to_numpy(), b.column(b.num_columns - 1).to_numpy()
            row = np.searchsorted(keys, size * step + np.minimum(rank, step - 1), "right") - 1
            row = np.maximum(row, first[size])
            _, r0, b0, per, offset = slots[row].T
            k = rank - r0
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(b0 + k // per), pa.array(offset + (k % per) * size)], [*keep, "sequence_id", "offset"])

    kinds = dict(pieces.dtypes)
    rows = ranked.select(*keep, F.col("length").cast("long").alias("_size"), (F.col("_before") + F.col("_r")).cast("long").alias("_rank"))
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``."""
    base = core.documents(docs, id_col, text_col)
    pieces = stage(base.select("_id", "_t").mapInArrow(*_pieces(tokenizer, limit, end_id, core.id_type(base))), "pack-pieces")
    placed = place(pieces.withColumn("_order", F.struct("_id", "piece")), limit)
    return placed.withColumnRenamed("_id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))

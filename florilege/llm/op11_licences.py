"""Licence texts and notices in documents.

Method: one generalised suffix automaton over the tokens of all templates and phrases. A document streams through
it, token by token, which gives its matching statistics: the longest piece of any template that ends at each word. On
the way from that state to the root lie all shorter pieces, so each template's own maximal matches are known, too, and whether
a whole template or phrase ends here. Matches of ``LEAST`` words and more of one template, in the same order in document and template and at most ``GAP`` words apart in both, are chained;
a chain that covers ``SHARE`` of its template is a span. Of overlapping spans the one with more words stays.

Words are what is left between ASCII signs, A-Z in lower case. Unknown words lead back to the root at once: they are found by
dictionary and skipped by numpy, so only neighbours from the templates' vocabulary are walked. Texts are read in parts of ``PART`` bytes; the
state goes on from part to part.

The score is 1 where a phrase or a whole template stands, else the largest share of a template that a chain covers.

Edge cases: null and empty texts have no words, no labels and score 0; a very long text is read in parts; repeated rows and null ids are scanned each;
of spans that cover equally many words (ties) the earlier stays, then the template named first; an empty table gives no rows;
columns other than id and text don't enter, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.llm import core
from florilege.llm.licences import PHRASES, TEMPLATES

LEAST = 4  # words of a match that may be chained
GAP = 16  # words between chained matches, in the document and in the template
SHARE = 0.75
PART = 1 << 20

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_END = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def words(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())  # of bytes, only A-Z change


def parts(text: bytes, most: int = PART) -> Iterator[bytes]:
    """A text in parts that end where a word ends."""
    at = 0
    while at < len(text):
        to = min(len(text), at + most)
        if to < len(text):
            end = _END.search(text, to)
            to = end.start() if end else len(text)
        yield text[at:to]
        at = to


class Automaton:
    """A suffix automaton of several token strings, with the places where each state's strings end."""

    def __init__(self, strings: list[list[int]]):
        self.strings = strings
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        for s in strings:
            last = 0
            for c in s:
                last = self._extend(last, c)
        self.ends: list[set[tuple[int, int]]] = [set() for _ in self.size]
        self.whole: list[list[int]] = [[] for _ in self.size]
        for t, s in enumerate(strings):
            v = 0
            for e, c in enumerate(s):
                v = self.next[v][c]
                self.ends[v].add((t, e))
            if s:
                self.whole[v].append(t)
        order = sorted(range(1, len(self.size)), key=self.size.__getitem__)
        for v in reversed(order):
            if self.link[v]:
                self.ends[self.link[v]] |= self.ends[v]
        for v in order:  # a template that ends at a suffix ends here, too
            self.whole[v] = self.whole[v] + self.whole[self.link[v]]
        self._near: dict[int, list[tuple[int, int, int]]] = {}

    def _state(self, size: int, link: int, steps: dict[int, int]) -> int:
        self.size.append(size)
        self.link.append(link)
        self.next.append(steps)
        return len(self.size) - 1

    def _split(self, p: int, c: int) -> int:
        """The state that p and c lead to, parted from longer strings if need be."""
        q = self.next[p][c]
        if self.size[q] == self.size[p] + 1:
            return q
        new = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new = self._state(self.size[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        self.link[new] = self._split(p, c) if p >= 0 else 0
        return new

    def step(self, v: int, n: int, c: int) -> tuple[int, int]:
        """The longest match after one more token, and its length."""
        while v and c not in self.next[v]:
            v = self.link[v]
            n = self.size[v]
        if c in self.next[v]:
            return self.next[v][c], n + 1
        return 0, 0

    def near(self, v: int, least: int) -> list[tuple[int, int, int]]:
        """(string, end, longest match that ends there) of a state and of its suffixes of ``least`` tokens and more."""
        if v not in self._near:
            out, seen, u = [], set(), v
            while u > 0 and self.size[u] >= least:
                out += [(t, e, self.size[u]) for t, e in sorted(self.ends[u] - seen)]
                seen |= self.ends[u]
                u = self.link[u]
            self._near[v] = out
        return self._near[v]


class Scanner:
    """Templates and phrases, ready to scan texts."""

    def __init__(self, templates: list[tuple[str, str]], phrases: list[tuple[str, str]], least: int = LEAST, gap: int = GAP, share: float = SHARE):
        given = [(label, words(text.encode())) for label, text in templates] + [(label, words(text.encode())) for text, label in phrases]
        self.labels = [label for label, _ in given]
        self.first_phrase, self.least, self.gap, self.share = len(templates), least, gap, share
        self.vocabulary: dict[bytes, int] = {}
        strings = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws] for _, ws in given]
        self.automaton = Automaton(strings)
        self.lengths = [len(s) for s in strings]
        self.alone = min((n for n in self.lengths if n), default=1) == 1  # is a single word a whole template?

    def read(self, text: bytes, part: int = PART) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Words; whole templates and phrases as (string, first word); maximal matches as (string, first word, first
        word in the string, words)."""
        a, get, least = self.automaton, self.vocabulary.get, self.least
        v, n, at, last = 0, 0, 0, -2
        whole: list[tuple[int, int]] = []
        longest: dict[tuple[int, int, int], int] = {}  # (string, offset between both, first word) -> words
        for piece in parts(text, part):
            ids = np.fromiter((get(w, -1) for w in words(piece)), np.int32)
            known = ids >= 0
            if not self.alone and len(ids):  # words without a known neighbour match nothing; at a part's ends they may
                near = np.zeros(len(ids), bool)
                near[1:] |= known[:-1]
                near[:-1] |= known[1:]
                near[[0, -1]] = True
                known &= near
            where = np.flatnonzero(known)
            for i, c in zip((where + at).tolist(), ids[where].tolist(), strict=True):
                v, n = a.step(v, n, c) if i == last + 1 else a.step(0, 0, c)
                last = i
                for t in a.whole[v]:
                    if self.lengths[t] <= n:
                        whole.append((t, i - self.lengths[t] + 1))
                if n >= least:
                    for t, e, size in a.near(v, least):
                        m = min(n, size)
                        longest[t, e - i, i - m + 1] = m
            at += len(ids)
        return at, whole, [(t, start, start + d, m) for (t, d, start), m in longest.items()]

    def chains(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(string, first word, end, words covered) of chained matches, each match in one chain."""
        out = []
        by: dict[int, list[tuple[int, int, int]]] = {}
        for t, start, inside, m in matches:
            if t < self.first_phrase:
                by.setdefault(t, []).append((start, inside, m))
        for t, ms in by.items():
            ms.sort()
            best, back, low = [], [], 0
            for j, (start, inside, m) in enumerate(ms):
                while ms[low][0] < start - self.gap - self.lengths[t]:
                    low += 1
                value, prev = m, -1
                for i in range(low, j):
                    s, k, l = ms[i]
                    if s < start and k < inside and s + l < start + m and k + l < inside + m and start - s - l <= self.gap and inside - k - l <= self.gap:
                        got = best[i] + m - max(0, s + l - start, k + l - inside)
                        if got > value:
                            value, prev = got, i
                best.append(value)
                back.append(prev)
            used = [False] * len(ms)
            for j in sorted(range(len(ms)), key=lambda j: (-best[j], ms[j])):
                chain, i = [], j
                while i >= 0:
                    chain.append(i)
                    i = back[i]
                if not any(used[i] for i in chain):
                    for i in chain:
                        used[i] = True
                    out.append((t, ms[chain[-1]][0], ms[j][0] + ms[j][2], best[j]))
        return out

    def scan(self, text: bytes) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int, int, float]], float]:
        """Words, phrases as (label, word), spans as (label, first word, end, words covered, share of the template), score."""
        n, whole, matches = self.read(text)
        base = [(self.labels[t], i) for t, i in whole if t >= self.first_phrase]
        found = [(t, i, i + self.lengths[t], self.lengths[t]) for t, i in whole if t < self.first_phrase] + self.chains(matches)
        score = 1.0 if base else max((c / self.lengths[t] for t, _, _, c in found), default=0.0)
        spans: list[tuple[str, int, int, int, float]] = []
        taken: list[tuple[int, int]] = []
        for t, start, end, covered in sorted(set(found), key=lambda x: (-x[3], x[1], x[0])):
            if covered >= self.share * self.lengths[t] and all(end <= x or y <= start for x, y in taken):
                taken.append((start, end))
                spans.append((self.labels[t], start, end, covered, covered / self.lengths[t]))
        return n, base, sorted(spans, key=lambda x: x[1]), score


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, least: int = LEAST, gap: int = GAP, share: float = SHARE) -> DataFrame:
    """``id_col, n_words, base`` (label and first word of each phrase), ``spans`` (label, first word, end, words covered, share of
    the template) and ``score``. The templates travel with the task; their automaton is built once in it."""
    base = core.documents(docs, id_col, text_col).select("_id", "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core.occupy("op11")
        scanner = Scanner(templates, phrases, least, gap, share)
        place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
        span = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("end", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]))
        for b in core.slices(batches):
            raw, off = core.utf8(b.column(1))
            got = [scanner.scan(raw[off[i] : off[i + 1]].tobytes()) for i in range(b.num_rows)]
            places = [[dict(zip(("label", "word"), x, strict=True)) for x in g[1]] for g in got]
            spans = [[dict(zip(("label", "word", "end", "covered", "share"), x, strict=True)) for x in g[2]] for g in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array(places, place), pa.array(spans, span), pa.array([g[3] for g in got], pa.float64())], ["_id", "n_words", "base", "spans", "score"])

    out = f"_id {core.id_type(base)}, n_words long, base array<struct<label:string,word:long>>, spans array<struct<label:string,word:long,end:long,covered:long,share:double>>, score double"
    return base.mapInArrow(run, out).withColumnRenamed("_id", id_col)


def _listed(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def query(spark, sf_dir: str) -> DataFrame:
    got = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    at = F.col("base.word")
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["word"].cast("string"), s["end"].cast("string")))
    return got.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), _listed(F.col("base.label")).alias("base_labels"),
        _listed(F.concat(F.col("base.label"), F.col("spans.label"))).alias("labels"), "score", F.array_join(spans, ",").alias("spans"))

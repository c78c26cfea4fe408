"""Personal data: exact patterns, and a linear-chain conditional random field for what they miss.

Method: a CRF over word-shape features with the labels O and B/I of each kind, trained by gradient steps
on the small labelled table below and decoded by Viterbi, many sequences at once in numpy. The table has numbers in the shapes of
phones, which only the words around them tell from phones. Its
sequences are the stretches of a text near a word with a digit, an @, a dotted host behind "at" or a spelt-out "at"/"dot" (four
words either side, five before a "dot", so that "ann at example dot com" is in one); the whole text is
searched for them. Long stretches are decoded in overlapping parts. What it finds must also be well formed for
its kind, and doesn't replace or overlap what the patterns found.

Edge cases: null and empty texts have no spans; offsets are code points, end excluded; repeated rows and
null ids are kept; a very long run of digits or letters costs linear time, and a very long text is read once; of equally
likely labellings (ties) the first in the order of LABELS counts; an empty table gives no rows; columns other than id and text don't
enter, whatever their names.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.llm import core

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

# --- patterns -----------------------------------------------------------------------------------
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin at the start of a run of digits; saying so keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def is_card(s: str) -> bool:
    d = digits(s)
    return 14 <= len(d) <= 19 and luhn(d)


def is_ip(s: str) -> bool:
    parts = s.split(".")
    return len(parts) == 4 and all(p.isdigit() and len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts)


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    p = text.find("@")
    while p >= 0:
        a = p
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, p + 1) if a < p else None
        if m:
            yield a, m.end()
            done = m.end()
        p = text.find("@", max(p + 1, done))


_DIGIT = re.compile("[0-9]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the exact patterns, sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if is_ip(m[0])]
        out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if is_card(m[0])]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


# --- the labelled table -------------------------------------------------------------------------
#: sentence frames; {kind} is filled with an example of that kind, {no} with a number that is nobody's, {like} with one
#: in a phone's shape that the words around it show to be none, {host} with a host that is no address, {at} with an
#: address that only the words around it tell from a {word} at a {host}
FRAMES = (
    "please write to {email} for details", "contact : {email} or call {phone}", "the host {ip} answered slowly", "card {card} was charged twice",
    "call {phone} before noon", "tel. {phone} , ask for the desk", "her mail is {email} .", "login from {ip} at night", "paid with {card} , thank you",
    "order {no} was sent", "in {no} people came", "token = \"{no}\" was removed", "version {no} is out", "page {no} of {no}", "it cost {no} in all", "see section {no} , table {no}",
    "the at sign and the dot are marks", "he was at home and she was not", "a dot on the map at the coast", "{phone}", "{email}", "{ip}", "{card}", "{no}",
    "words before {phone} words after", "words before {email} words after", "words before {ip} words after", "words before {card} words after", "words before {no} words after",
    "order {like} was shipped", "in the range {like} km", "invoice {like} is due", "part {like} is sold out", "serial {like} on the back", "isbn {like} , second edition", "a score of {like} in the end", "the code {like} opens it", "ticket {like} was closed", "from {like} units of it", "reference {like} in your letter",
    "order {like} came , call {phone} if not", "look at {host} for more", "it is hosted at {host} now", "found at {host} by us", "you can see it at {host} today", "the site at {host} is down", "visit us at {host} or call {phone}", "mail me : {email}", "send it to {email} please", "reach me at {phone} or {email}", "my number is {phone} , ask for ann", "phone {phone} or fax {phone}", "ask {email} about it",
    "write to {at} today", "ask {at} about it", "contact : {at}", "mail {at} please", "{at}", "send me a line , {at}", "you reach {at} at night", "just contact {at} instead",
    "the {word} at {host} was good", "she {word} at {host} all day", "words before {word} at {host} words after", "a {word} at {host} , they say", "we {word} at {host} and home",
)


def _example(kind: str, r: random.Random) -> str:
    def num(n: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(n))

    def word() -> str:
        return "".join(r.choice(("ka", "lo", "mi", "ter", "san", "vo", "re")) for _ in range(r.randint(1, 3)))

    if kind == "email":
        host = f"{word()}{r.choice(('', num(1)))}"
        end = r.choice(("com", "org", "net", "ch"))
        return r.choice((f"{word()}{num(2)}@{host}.{end}", f"{word()} at {host} dot {end}", f"{word()} (at) {host} (dot) {end}", f"{word()} [at] {host} [dot] {end}", f"{word()}[at]{host}.{end}", f"{word()}(at){host}.{end}", f"{word()} (at) {host}.{end}", f"{word()} [at] {host}.{end}", f"{word()} @ {host} . {end}", f"{word()} @ {host}.{end}", f"{word()}.{word()} at {host} dot {end}"))
    if kind == "ip":
        return ".".join(str(r.randint(1, 255)) for _ in range(4)) + r.choice(("", "", ":8080"))
    if kind == "card":
        body = r.choice("45") + num(14)
        full = next(body + c for c in "0123456789" if luhn(body + c))
        return r.choice((full, " ".join(full[i : i + 4] for i in range(0, 16, 4)), "-".join(full[i : i + 4] for i in range(0, 16, 4)), ".".join(full[i : i + 4] for i in range(0, 16, 4))))
    if kind == "phone":
        return r.choice((f"+1 ({num(3)}) 555-{num(4)}", f"({num(3)}) 555-{num(4)}", f"{num(3)}-555-{num(4)}", f"0{num(2)} {num(3)} {num(2)} {num(2)}", f"+41 {num(2)} {num(3)} {num(2)} {num(2)}", f"{num(3)}.555.{num(4)}", f"0{num(2)} {num(4)} {num(4)}", f"{num(3)} {num(3)} {num(4)}", f"00{num(2)} {num(2)} {num(3)} {num(2)} {num(2)}", f"{num(3)}-{num(3)}-{num(4)}"))
    if kind == "at":
        return f"{word()} at {word()}{r.choice(('', num(1)))}.{r.choice(('com', 'org', 'net', 'ch'))}"
    if kind == "word":
        return word()
    if kind == "like":
        return r.choice((f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)} {num(3)} {num(2)} {num(2)}", f"{num(3)} {num(3)} {num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"{num(3)}-{num(1)}-{num(2)}-{num(6)}-{num(1)}"))
    if kind == "host":
        return f"{word()}{r.choice(('', num(1)))}.{r.choice(('com', 'org', 'net', 'ch'))}"
    return r.choice((num(1), num(2), num(4), num(14), num(16), f"{num(1)}.{num(1)}", f"{num(2)},{num(3)}", f"{num(2)}%", f"19{num(2)}-0{num(1)}-1{num(1)}", "".join(r.choice("0123456789abcdef") for _ in range(40)), f"{num(3)}-{num(2)}", f"{word()}{num(2)}"))


def labelled_table(rows: int = 1200, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """Words and labels of the training sentences: FRAMES filled with examples."""
    r, out = random.Random(seed), []
    for i in range(rows):
        words, labels = [], []
        for part in FRAMES[i % len(FRAMES)].split():
            m = re.search(r"\{(\w+)\}", part)
            if not m:
                words.append(part)
                labels.append("O")
                continue
            kind = m[1]
            name = "email" if kind == "at" else kind
            got = part.replace(m[0], _example(kind, r)).split()
            words += got
            labels += ["O"] * len(got) if kind in ("no", "like", "host", "word") else [f"B-{name}", *[f"I-{name}"] * (len(got) - 1)]
        out.append((words, labels))
    return out


# --- the model ----------------------------------------------------------------------------------
_EDGE = ".,;:!?\"'“”«»"
#: words that tell what a number or an address is
_KNOWN = frozenset("at dot (at) (dot) [at] [dot] tel tel. call mail contact : card host ip from phone @ . fax number write reach ask send me order range km invoice part serial isbn score code ticket units reference look hosted found see site visit".split())


def shape(word: str) -> str:
    """X, x and d for upper, lower and digit, runs shortened to their length up to 4."""
    out, last, run = [], "", 0
    for c in word[:24]:
        s = "d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        run = run + 1 if s == last else 1
        last = s
        if s in "Xx" and run > 1 or run > 4:
            continue
        out.append(s)
    return "".join(out)


def features(words: list[str], i: int) -> list[str]:
    def at(k: int) -> str:
        return (words[k].strip(_EDGE) or words[k]) if 0 <= k < len(words) else "<edge>"

    w = at(i)
    n = sum(c.isdigit() for c in w)
    out = ["bias", "s=" + shape(w), "p=" + shape(at(i - 1)), "n=" + shape(at(i + 1)), f"d={min(n, 5)}", "sp=" + shape(at(i - 1)) + "|" + shape(w), "sn=" + shape(w) + "|" + shape(at(i + 1))]
    for tag, k in (("w", i), ("pw", i - 1), ("nw", i + 1), ("ppw", i - 2), ("nnw", i + 2)):
        v = at(k).lower()
        if v in _KNOWN:
            out.append(f"{tag}={v}")
    if "@" in w or "(at)" in w.lower() or "[at]" in w.lower():
        out.append("has at")
    if "." in w and _DOMAIN.fullmatch(w) and w[-1].isalpha():
        out.append("host")
        if at(i - 1).lower() in ("at", "@", "(at)", "[at]"):
            out.append("host behind " + at(i - 2).lower() if at(i - 2).lower() in _KNOWN else "host behind another")
    if w.lower() == "at" and "." in at(i + 1) and _DOMAIN.fullmatch(at(i + 1)) and at(i + 1)[-1].isalpha():
        out.append("at a host, " + (at(i - 1).lower() if at(i - 1).lower() in _KNOWN else "by another"))
    if at(i + 1).lower() == "at" and "." in at(i + 2) and _DOMAIN.fullmatch(at(i + 2)) and at(i + 2)[-1].isalpha():
        out.append("before a host, " + (w.lower() if w.lower() in _KNOWN else "another"))
    # what stands before a number of several words
    k = i
    while n and k > i - 4 and any(c.isdigit() for c in at(k - 1)) and at(k - 1) != "<edge>":
        k -= 1
    if n and at(k - 1).lower() in _KNOWN:
        out.append("number of " + at(k - 1).lower())
    if n and is_ip(w.split(":")[0]):
        out.append("is ip")
    if n >= 14 and is_card(w):
        out.append("is card")
    if 10 <= n <= 12 and any(c in w for c in "-.()"):
        out.append("grouped digits")
    return out


class Crf:
    def __init__(self, vocabulary: dict[str, int], emit: np.ndarray, move: np.ndarray, begin: np.ndarray):
        self.vocabulary, self.emit, self.move, self.begin = vocabulary, emit, move, begin

    def scores(self, rows: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Emission scores padded to (sequences, longest, labels), and the lengths."""
        size = np.array([len(r) for r in rows])
        out = np.zeros((len(rows), size.max(), len(LABELS)))
        for b, r in enumerate(rows):
            for t, fs in enumerate(r):
                ids = [self.vocabulary[f] for f in fs if f in self.vocabulary]
                out[b, t] = self.emit[ids].sum(axis=0)
        return out, size

    def viterbi(self, rows: list[list[list[str]]]) -> list[np.ndarray]:
        """The best label sequence of each, all sequences of a batch advancing together."""
        if not rows:
            return []
        e, size = self.scores(rows)
        best = e[:, 0] + self.begin
        back = np.zeros(e.shape, np.int64)
        ends = np.where((size == 1)[:, None], best, 0)
        for t in range(1, e.shape[1]):
            step = best[:, :, None] + self.move[None]
            back[:, t] = step.argmax(axis=1)
            best = step.max(axis=1) + e[:, t]
            ends = np.where((size == t + 1)[:, None], best, ends)
        out = []
        for b, n in enumerate(size.tolist()):
            path = [int(ends[b].argmax())]
            for t in range(n - 1, 0, -1):
                path.append(int(back[b, t, path[-1]]))
            out.append(np.array(path[::-1]))
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def likelihood(params: list[np.ndarray], where: tuple[np.ndarray, np.ndarray, np.ndarray], on: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Log-likelihood of the labels ``y`` and its gradients by forward-backward. ``where``: sequence, word and feature of each feature that
    is set; ``on``: which words a sequence has."""
    W, M, S = params
    n, T = on.shape
    L = len(S)
    wb, wt, wf = where
    e = np.zeros((n, T, L))
    np.add.at(e, (wb, wt), W[wf])
    alpha = np.zeros_like(e)
    alpha[:, 0] = e[:, 0] + S
    for t in range(1, T):
        alpha[:, t] = np.where(on[:, t, None], _lse(alpha[:, t - 1, :, None] + M, 1) + e[:, t], alpha[:, t - 1])
    z = _lse(alpha[:, -1], 1)
    beta = np.zeros_like(e)
    for t in range(T - 2, -1, -1):
        beta[:, t] = np.where(on[:, t + 1, None], _lse(M[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
    onehot = np.eye(L)[y] * on[:, :, None]
    diff = onehot - np.exp(alpha + beta - z[:, None, None]) * on[:, :, None]
    gW = np.zeros_like(W)
    np.add.at(gW, wf, diff[wb, wt])
    gM = np.zeros((L, L))
    gold = (e * onehot).sum() + S[y[:, 0]].sum()
    for t in range(1, T):
        live = on[:, t]
        pair = np.exp(alpha[live, t - 1, :, None] + M + (e[live, t] + beta[live, t])[:, None, :] - z[live, None, None])
        gM -= pair.sum(axis=0)
        np.add.at(gM, (y[live, t - 1], y[live, t]), 1)
        gold += M[y[live, t - 1], y[live, t]].sum()
    return float(gold - z.sum()), [gW, gM, diff[:, 0].sum(axis=0)]


@cache
def trained(rows: int = 1200, rounds: int = 120, seed: int = 5) -> Crf:
    """Maximum likelihood with an L2 penalty: forward-backward gradients, Adam steps."""
    table = labelled_table(rows, seed)
    feats = [[features(w, i) for i in range(len(w))] for w, _ in table]
    vocabulary = {f: i for i, f in enumerate(sorted({f for r in feats for fs in r for f in fs}))}
    L = len(LABELS)
    gold = [np.array([LABELS.index(x) for x in y]) for _, y in table]
    size = np.array([len(y) for y in gold])
    T = int(size.max())
    where = [(b, t, vocabulary[f]) for b, r in enumerate(feats) for t, fs in enumerate(r) for f in fs]
    wb, wt, wf = (np.array(x) for x in zip(*where, strict=True))
    on = np.arange(T)[None] < size[:, None]
    y = np.zeros((len(gold), T), np.int64)
    for b, g in enumerate(gold):
        y[b, : len(g)] = g
    params = [np.zeros((len(vocabulary), L)), np.zeros((L, L)), np.zeros(L)]
    # I-kind follows only B-kind or I-kind
    banned = np.zeros((L, L))
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            for i, a in enumerate(LABELS):
                if a[2:] != b[2:]:
                    banned[i, j] = -50.0
    start = np.array([-50.0 if x[0] == "I" else 0.0 for x in LABELS])
    m = [np.zeros_like(p) for p in params]
    v = [np.zeros_like(p) for p in params]
    for k in range(1, rounds + 1):
        _, grads = likelihood([params[0], params[1] + banned, params[2] + start], (wb, wt, wf), on, y)
        grads = [g - 0.05 * p for g, p in zip(grads, params, strict=True)]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            params[i] = params[i] + 0.15 * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.99**k)) + 1e-8)
    return Crf(vocabulary, params[0], params[1] + banned, params[2] + start)


_TRIGGER = re.compile(r"[0-9@]|[(\[](?:at|dot)[)\]]|\bdot\b|(?<=at )[A-Za-z0-9-]+\.[A-Za-z]", re.I)
_WORD = re.compile(r"[^\s]+")
_DOT = re.compile(r"[(\[]dot[)\]]|\bdot\b", re.I)
REACH = 4
BEFORE_DOT = 5  # local part, "at" and host, and the two words before them
LONGEST = 128  # words of one sequence; longer stretches (number tables) continue in the next
MARGIN = 20  # a sequence begins so many words before the last one's spans end to count; a card in single digits has 19


def stretches(text: str) -> Iterator[tuple[list[tuple[int, int]], int, int]]:
    """Word ranges near triggers, as sequences, and from which to which word (excluded) of it spans may begin."""
    if not _TRIGGER.search(text):
        return
    words = [m.span() for m in _WORD.finditer(text)]
    hot = np.fromiter((bool(_TRIGGER.search(text, a, b)) for a, b in words), bool, len(words))
    near = np.convolve(hot, np.ones(2 * REACH + 1), "full")[REACH : REACH + len(words)] > 0 if len(words) else hot
    if _DOT.search(text):
        for i in [i for i in np.flatnonzero(hot).tolist() if _DOT.search(text, *words[i])]:
            near[max(0, i - BEFORE_DOT) : i] = True
    edge = np.flatnonzero(np.diff(np.concatenate(([0], near.astype(np.int8), [0]))))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        k, lo = a, 0
        while b - k > LONGEST:
            yield words[k : k + LONGEST], lo, LONGEST - MARGIN
            k, lo = k + LONGEST - 2 * MARGIN, MARGIN
        yield words[k:b], lo, b - k


def well_formed(kind: int, s: str) -> bool:
    if kind == 0:
        return bool(re.fullmatch(r"[\w.%+-]+(?:\s*@\s*|\s*[(\[]at[)\]]\s*|\s+at\s+)[A-Za-z0-9-]+(?:(?:\s*\.\s*|\s*[(\[]dot[)\]]\s*|\s+dot\s+)[A-Za-z0-9-]+)+", s, re.I))
    if kind == 1:
        return is_ip(s.split(":")[0])
    if kind == 2:
        return is_card(s) and bool(re.fullmatch(r"[0-9](?:[ .-]?[0-9])+", s))
    return 9 <= len(digits(s)) <= 15 and bool(re.fullmatch(r"\+?[0-9(][0-9 ().-]*[0-9]", s)) and bool(re.search(r"[ ().-]", s)) and not is_ip(s)


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], model: Crf, batch: int = 256) -> list[list[tuple[int, int, int]]]:
    """What the model finds beyond the base spans of each text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    held: list[tuple[int, list[tuple[int, int]], int, int]] = []

    def settle() -> None:
        rows = []
        for i, seq, _, _ in held:
            words = [texts[i][a:b] for a, b in seq]
            rows.append([features(words, t) for t in range(len(words))])
        for (i, seq, lo, hi), path in zip(held, model.viterbi(rows), strict=True):
            t = 0
            while t < len(path):
                label = LABELS[path[t]]
                u = t + 1
                if label[0] == "B":
                    while u < len(path) and LABELS[path[u]] == "I" + label[1:]:
                        u += 1
                    a, b = seq[t][0], seq[u - 1][1]
                    while b > a and texts[i][b - 1] in _EDGE:
                        b -= 1
                    while a < b and texts[i][a] in _EDGE:
                        a += 1
                    kind = KINDS.index(label[2:])
                    if lo <= t < hi and (not out[i] or out[i][-1][2] <= a) and well_formed(kind, texts[i][a:b]) and all(b <= x or y <= a for x, _, y in base[i]):
                        out[i].append((a, kind, b))
                t = u
        held.clear()

    for i, text in enumerate(texts):
        for seq, lo, hi in stretches(text):
            held.append((i, seq, lo, hi))
            if len(held) == batch:
                settle()
    settle()
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Crf | None = None) -> DataFrame:
    """``id_col`` and ``spans``: array of (start, kind number, end, added), sorted by start and kind; ``added``
    tells the model's spans from the patterns'."""
    base = core.documents(docs, id_col, text_col).select("_id", "_t")
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("added", pa.bool_())]))
        for b in core.slices(batches):
            texts = ["" if t is None else t for t in b.column(1).to_pylist()]
            found = [base_spans(t) for t in texts]
            more = added_spans(texts, found, model)
            rows = [sorted([(*s, False) for s in f] + [(*s, True) for s in m]) for f, m in zip(found, more, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[{"start": a, "kind": k, "end": e, "added": x} for a, k, e, x in r] for r in rows], kind)], ["_id", "spans"])

    return base.mapInArrow(run, f"_id {core.id_type(base)}, spans array<struct<start:long,kind:int,end:long,added:boolean>>").withColumnRenamed("_id", id_col)


def _is(kind: int):
    return lambda s: s["kind"] == kind


def listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    got = find(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("_base", F.filter("spans", lambda s: ~s["added"]))
    count = {k: F.size(F.filter("_base", _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)}
    return got.select("doc_id", *count.values(), F.sha2(listed(F.col("_base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))

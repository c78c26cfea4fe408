"""Main text of web pages by line-block distribution.

Method: markup is stripped to lines, one per block element. A line's weight is its text outside links;
lines in places that never hold an article (menus, headers, footers, asides, forms, adverts, notices,
comment threads) weigh nothing. Weights are summed over sliding windows of lines. A region is found where the sum
surges above the threshold; it begins where the sum rose from zero and ends where it dives to zero; text between
surge and dive points is kept, region by region, but for lines in such places. A line without weight of its own (a
linked one) stays if text surrounds it, also where up to ``LINKED`` of them part two regions, or if it is a paragraph or heading at a region's
end, fewer than a window of them. Where no region surges, the heaviest one is kept. Where a page has
an ``article``/``main`` element with text, its lines surge and no others do.

A form is such a place unless it is the page's frame: one with an ``article``/``main`` inside, or one that holds most of the text
outside such places and surges.

Edge cases: null or empty html, and pages without text, give an empty string; unclosed elements run to
the end of the page, an unfinished tag there is dropped; a very long page is read once, in time that follows its length;
of equally heavy regions the first counts (ties); repeated rows and null ids are kept; an empty table gives an empty
result; other columns, whatever their names, stay, but one named like the output gives way.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 80  # characters outside links within WINDOW lines
LINKED = 3  # lines without weight between two regions of one article
RAW = "script|style|noscript|template|title|textarea|svg|iframe|object|canvas"
#: elements that begin and end a line
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: elements whose text is never the article
ASIDE = frozenset("nav header footer aside menu dialog button select head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: class or id words of such places
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices alert disclaimer sidebar menu nav navbar navigation breadcrumb breadcrumbs header footer masthead comment comments respond reply replies disqus related recommended share sharing social newsletter subscribe subscription signup login popup modal toolbar pagination pager widget copyright".split()
)
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote figcaption".split())
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-z][^<>]*\Z|<\Z",
    re.S | re.I,
)
#: words that go with them in compound names and say nothing by themselves
PLAIN = frozenset("site page main top bottom left right list item items box block container wrapper wrap section area inner outer bar links global primary secondary form col column unit slot buttons button icons icon first last".split())
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[a-z]+")


def marked(attrs: str, article: bool = False) -> bool:
    """Whether a class, id or role names a place that never holds an article. Of a compound name (``site-header``) every
    part must say so or nothing: ``no-sidebar``, ``article-header`` and ``sharing-economy`` name no such place. A header inside an
    article is its own."""
    for n in _NAMES.findall(attrs):
        for name in "".join(n).lower().split():
            parts = _PARTS.findall(name)
            if article and "header" in parts:
                continue
            if not MARKS.isdisjoint(parts) and all(x in MARKS or x in PLAIN for x in parts):
                return True
    return False


def lines_of(page: str) -> tuple[list[str], list[int], list[bool], list[bool], list[int], list[bool]]:
    """Text lines in page order, the weight of each (its text outside links, none in places that never hold an article),
    whether it lies in an article element, whether in such a place, in which form if nothing else puts it aside (0: none), and
    whether it is a paragraph or heading."""
    lines: list[str] = []
    weights: list[int] = []
    inside: list[bool] = []
    outside: list[bool] = []
    framed: list[int] = []
    proper: list[bool] = []
    form = forms = 0  # the outermost open form, and how many there have been
    text: list[str] = []
    plain: list[str] = []  # the part of it outside links
    open_: list[tuple[str, bool, bool]] = []  # tag, not article text, article element
    count: dict[str, int] = {}  # open elements of each tag
    aside = article = links = 0

    def add(piece: str) -> None:
        if piece:
            text.append(piece)
            if not links:
                plain.append(piece)

    def flush() -> None:
        line = " ".join(html.unescape("".join(text)).split())
        if line:
            lines.append(line)
            weights.append(0 if aside else len(" ".join(html.unescape("".join(plain)).split())))
            inside.append(article > 0 and not aside)
            outside.append(aside > 0)
            framed.append(form if not aside else 0)
            proper.append(any(count.get(x) for x in PARAGRAPHS))
        text.clear()
        plain.clear()

    def close(i: int) -> None:
        nonlocal aside, article, links, form
        for tag, off, art in open_[i:]:
            aside -= off
            form = 0 if tag == "form" and count[tag] == 1 else form
            article -= art
            links -= tag == "a"
            count[tag] -= 1
        del open_[i:]

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS or tag == "br":
            flush()
        if m["end"]:
            if count.get(tag):
                i = len(open_) - 1
                while open_[i][0] != tag:
                    i -= 1
                close(i)
        elif tag not in VOID and not m["attrs"].endswith("/"):
            if tag in ("p", "li") or tag in BLOCKS:  # an open paragraph ends at the next block
                if open_ and open_[-1][0] == "p" or (tag == "li" and open_ and open_[-1][0] == "li"):
                    close(len(open_) - 1)
            # a heading group of the article itself is part of it
            off = tag in ASIDE and not (tag == "header" and article) or "=" in m["attrs"] and tag not in ("html", "body", "article", "main", "form") and marked(m["attrs"], article > 0)
            art = tag in ("article", "main") and not aside
            if tag == "form":
                forms += 1
                # a form in an article or in a form is none of the text; any other may turn out to be the page's frame
                off, form = article > 0 or form > 0, form or (0 if article else forms)
            open_.append((tag, off, art))
            count[tag] = count.get(tag, 0) + 1
            aside += off
            article += art
            links += tag == "a"
    add(page[at:])
    flush()
    return lines, weights, inside, outside, framed, proper


def regions(weights: np.ndarray, surge: float, window: int) -> list[tuple[int, int]]:
    """Line ranges (end excluded) between surge and dive points. The sum of the ``window`` lines from i on surges where it
    reaches ``surge``; the region begins with the text that led there without a break, and goes on while the
    sum is above zero: up to ``window`` - 1 lines without weight in a row don't end it. Where nothing
    surges, the heaviest stretch between dives is taken."""
    n = len(weights)
    if not n or not weights.any():
        return []
    total = np.concatenate(([0], np.cumsum(weights)))
    block = total[np.minimum(np.arange(n) + window, n)] - total[:n]
    alive = np.flatnonzero(np.diff(np.concatenate(([0], (block > 0).astype(np.int8), [0]))))
    out, best = [], (0, None)
    for a, b in zip(alive[::2].tolist(), alive[1::2].tolist(), strict=True):  # sums rise at a and have dived to zero at b
        ink = np.flatnonzero(weights[a:b]) + a  # a sum rises up to window - 1 lines ahead of the text
        span = (int(ink[0]), int(ink[-1]) + 1)
        if block[a:b].max() >= surge:
            out.append(span)
        if (w := int(total[b] - total[a])) > best[0]:
            best = (w, span)
    return out or [best[1]]


def joined(spans: list[tuple[int, int]], off: np.ndarray, proper: np.ndarray, weights: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Regions grown over lines that only links kept from weighing: a few between two of them, and paragraphs and headings right
    before or behind."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a - out[-1][1] <= LINKED and not off[out[-1][1] : a].any() and not weights[out[-1][1] : a].any():
            out[-1] = out[-1][0], b
        else:
            out.append((a, b))

    def grows(i: int) -> bool:
        return 0 <= i < len(off) and proper[i] and not off[i] and not weights[i]

    def run(i: int, step: int) -> int:
        n = 0
        while grows(i + n * step):
            n += 1
        return n if n < window else 0

    for k, (a, b) in enumerate(out):
        out[k] = a - run(a - 1, -1), b + run(b, 1)
    return out


def main_text(page: str | None, window: int = WINDOW, surge: float = SURGE) -> str:
    if not page:
        return ""
    lines, weights, inside, outside, framed, proper = lines_of(page)
    if not lines:
        return ""
    w = np.array(weights, np.int64)
    art, off, form = np.array(inside), np.array(outside), np.array(framed)
    if (w[art] > 0).any():
        # the page says where the article is: every line there weighs what a surge takes, linked or not
        w = np.where(art, np.maximum(w, math.ceil(surge)), 0)
        off = ~art
        return "\n".join(lines[i] for a, b in regions(w, surge, window) for i in range(a, b) if not off[i])
    for k in np.unique(form[form > 0]):
        mine = np.where(form == k, w, 0)
        if 2 * mine.sum() <= w.sum() or np.convolve(mine, np.ones(window, np.int64)).max() < surge:
            off = off | (form == k)  # a form like any other
    w = np.where(off, 0, w)
    return "\n".join(lines[i] for a, b in joined(regions(w, surge, window), off, np.array(proper), w, window) for i in range(a, b) if not off[i])


def extract(pages: DataFrame, html_col: str = "html", out: str = "text", window: int = WINDOW, surge: float = SURGE) -> DataFrame:
    """The table with ``html_col`` replaced by the main text in ``out``; other columns pass through."""
    from pyspark.sql.types import StringType, StructField, StructType

    others = [c for c in pages.columns if c not in (html_col, out)]
    row = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)))
    packed = pages.select(row.alias("_row"), F.col(f"`{html_col}`").cast("string").alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                text = [main_text(x.as_py(), window, surge) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string())], ["_row", "_x"])

    got = packed.mapInArrow(run, StructType([packed.schema["_row"], StructField("_x", StringType())]))
    return got.select(*(F.col(f"_row.c{i}").alias(c) for i, c in enumerate(others)), F.col("_x").alias(out))


def query(spark, sf_dir: str) -> DataFrame:
    got = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

"""Rule induction against exhaustive search, extraction on pages whose article is known."""

import html
import math
import random

import numpy as np

from florilege.llm import op2_extraction as op2
from florilege.llm import op7_quality as op7


def gain(p, n, p0, n0):
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0


def every_test(x):
    """All threshold tests halfway between neighbouring values."""
    for name, v in x.items():
        u = sorted(set(v.tolist()))
        for a, b in zip(u, u[1:], strict=False):
            for above in (False, True):
                yield op7.Test(name, above, round((a + b) / 2, 6))


def test_each_grown_test_has_the_best_gain():
    r = np.random.default_rng(3)
    for _ in range(25):
        n = int(r.integers(6, 40))
        x = {k: r.integers(0, 12, n) / 10 for k in ("a", "b", "c")}
        bad = (x["a"] > 0.6) & (x["b"] < 0.7) | (r.random(n) < 0.15)
        if not bad.any() or bad.all():
            continue
        live = np.ones(n, bool)
        for t in op7._grow(x, bad, 4):
            p0, n0 = int((live & bad).sum()), int((live & ~bad).sum())

            def worth(t, live=live, p0=p0, n0=n0):
                c = t.holds(x) & live
                return gain(int((c & bad).sum()), int((c & ~bad).sum()), p0, n0)

            assert worth(t) >= max(worth(u) for u in every_test({k: v[live] for k, v in x.items()})) - 1e-9
            live &= t.holds(x)


def test_rules_cover_what_they_say_and_are_pruned():
    r = np.random.default_rng(5)
    n = 600
    x = {k: r.random(n).round(3) for k in ("a", "b", "c")}
    bad = (x["a"] > 0.8) | ((x["b"] < 0.2) & (x["c"] > 0.5))
    turn = np.arange(n) % 3
    rules = op7.induce(x, bad, turn)
    live = np.ones(n, bool)
    for rule in rules:
        c = op7.holds(rule.tests, x) & live
        assert (int((c & bad).sum()), int((c & ~bad).sum())) == (rule.hits, rule.misses) and rule.hits >= 0.8 * (rule.hits + rule.misses)
        live &= ~c
    assert (live & bad).sum() <= 0.05 * bad.sum() and (~live & ~bad).sum() <= 0.05 * n
    # no shorter head of a rule is worth more on the pruning rows
    tests = (op7.Test("a", True, 0.8), op7.Test("b", True, 0.0), op7.Test("c", False, 0.3))
    kept = op7._prune(tests, x, bad)

    def worth(k):
        c = op7.holds(tests[:k], x)
        p, q = int((c & bad).sum()), int((c & ~bad).sum())
        return (p - q) / (p + q)

    assert len(kept) == max(range(1, 4), key=lambda k: (worth(k), -k))


WORDS = "river stone market evening window garden letter bridge winter music harbour silver people answer morning little across".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


def dressed(r, text):
    """A block's text with inline markup, references and odd white space, which change nothing."""
    out = []
    for w in text.split(" "):
        w = html.escape(w) if r.random() < 0.9 else "".join(f"&#{ord(c)};" for c in w)
        out.append(r.choice(("{}", "{}", "{}", "<b>{}</b>", "<em class='x'>{}</em>", "<a href='/l'>{}</a>", "{}<!-- c -->")).format(w))
    return r.choice((" ", "\n  ")).join(out)


def page_and_text(r):
    """A random page and its main text, put together block by block."""
    blocks = [("h1", prose(r, 4))] + [("p", prose(r, r.randint(18, 60)) + r.choice(("", " 3 < 4 & 5 > 2", ' "so" it goes'))) for _ in range(r.randint(2, 7))]
    if r.random() < 0.5:
        blocks.insert(2, ("blockquote", prose(r, 20)))
    body = "".join(f"<{t}>{dressed(r, x)}</{t}>" for t, x in blocks)
    if r.random() < 0.5:  # asides within
        body = body.replace("</p>", r.choice(("</p><div class='ad'>Buy it now, the best thing of all</div>", "</p><aside>Aside words of some length here</aside>", "</p><script>var x = '<p>no</p>';</script>")), 1)
    art = r.choice(("<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>", "<div id='story'><div>{}</div></div>")).format(body)
    links = "".join(f"<li><a href='/{k}'>{prose(r, 2)}</a></li>" for k in range(r.randint(2, 9)))
    head = r.choice((f"<nav><ul>{links}</ul></nav>", f"<div class='menu'>{links}</div>", f"<header><h2>{prose(r, 3)}</h2><ul>{links}</ul></header>"))
    tail = r.choice(("<footer>&copy; all of it</footer>", f"<div id='comments'><p>{prose(r, 40)}</p></div><div class='footer'>{prose(r, 9)}</div>", "<form><label>Your mail</label><input><button>Go</button></form>", f"<aside>{prose(r, 30)}</aside>"))
    frame = r.choice(("<html><head><title>T</title><style>p{{}}</style></head><body>{}</body></html>", "{}", "<body><form id='page'>{}</form></body>"))
    return frame.format(head + art + tail), "\n".join(" ".join(x.split()) for _, x in blocks)


def test_extraction_of_pages_whose_article_is_known():
    r = random.Random(11)
    for _ in range(400):
        page, text = page_and_text(r)
        assert op2.main_text(page) == text, page

"""Packing, extraction, personal data, quality rules and toxicity."""

import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from florilege.llm import op1_packing as op1
from florilege.llm import op2_extraction as op2
from florilege.llm import op6_pii as op6
from florilege.llm import op7_quality as op7
from florilege.llm import op8_decontamination as op8
from florilege.llm import op9_toxicity as op9
from tests.llm.fixtures import empty, sentence, table, texts

tokenizers = pytest.importorskip("public_tokenizers")


def test_packing(spark):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    odd = [(20, "it's don't I'LL 'tis"), (21, "İstanbul ΣΑΣ. ΟΔΟΣ"), (22, "<|endoftext|> <|EndOfText|>."), (23, "é ́ x. .́"), (24, "a\x0bb\x0cc\x85d e"), (25, "12.5% $3,000!!"), (26, "日本語 テスト、です。½")]
    rows = texts() + odd
    got = op1.pack(table(spark, rows), path).collect()
    want = []
    for i, t in rows:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for off, n in sorted(places):
            assert off == at
            at += n
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 1
    assert op1.pack(empty(spark), path).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="ad">Buy this now, it is the best thing</div>{0}<aside>Side text of some length here</aside><div id="comments"><p>First! I have a long opinion on this article and will now tell it.</p></div><form>Name <input> <button>Go</button></form>
<footer>&copy; x &middot; legal text</footer></body></html>"""


def test_extraction(spark):
    article = "<article><h1>Head &amp; line</h1><p><b>Be.<br><p>Some   <i>inner</i>\nwords&#33;<nav>x</nav><p>Last</article>"
    plain = "<div><p>" + "A paragraph that is long enough to surge over any threshold. " * 3 + "</p><p>Short.</p></div>"
    pages = [(1, PAGE.replace("{0}", article)), (2, PAGE.replace("{0}", plain)), (3, None), (4, ""), (5, "no markup at all"), (6, "<p>cut <b>off <foo"), (6, "<p>cut <b>off <foo"), (None, "<p>" * 30000 + "deep"), (7, "<nav>only menu</nav>")]
    df = spark.createDataFrame([(i, h, "u", "old") for i, h in pages], "page_id long, html string, url string, text string")
    got = sorted(((r.page_id, r.text) for r in op2.extract(df).collect()), key=str)
    long = " ".join(["A paragraph that is long enough to surge over any threshold."] * 3)
    assert got == sorted([(1, "Head & line\nBe.\nSome inner words!\nLast"), (2, f"{long}\nShort."), (3, ""), (4, ""), (5, "no markup at all"), (6, "cut off"), (6, "cut off"), (None, "deep"), (7, "")], key=str)
    assert op2.extract(df.limit(0)).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and op6.luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans():
    cases = ["a@b@c.com", "x.y@z-1.co.uk.", "a@b", "@x.com", "1.2.3.4.5.6.7.8", "300.1.1.1 1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111 12", "+1 (026) 555-4081 190.137.2.1", "+1 (017) 555-7713", "++1 234 567 890", "é a@b.c é 00001.2.3.255", "a.b@c.d@e.f", "1-2 3--4"]
    for c in cases + [" ".join(cases)]:
        assert op6.base_spans(c) == plain_spans(c), c
    assert op6.base_spans("a" * 200_000 + "@" + "1" * 200_000) == []  # linear


def test_crf_on_sentences_it_has_not_seen():
    model = op6.trained()
    rows = op6.labelled_table(200, seed=99)
    paths = model.viterbi([[op6.features(w, i) for i in range(len(w))] for w, _ in rows])
    right = sum(op6.LABELS[a] == b for p, (_, y) in zip(paths, rows, strict=True) for a, b in zip(p, y, strict=True))
    assert right / sum(len(w) for w, _ in rows) > 0.98
    # the batch decoder agrees with one sequence at a time
    assert all((model.viterbi([[op6.features(w, i) for i in range(len(w))]])[0] == p).all() for (w, _), p in zip(rows[:20], paths, strict=False))


def test_pii(spark):
    rows = [(1, "write to ann at mail7 dot com or (555) 555-1234, ok"), (2, "é a@b.co 10.0.0.1"), (3, None), (4, ""), (5, "he was at home"), (5, "he was at home"), (None, "x " * 50_000 + "a@b.co")]
    got = {(r.doc_id, tuple((s.kind, s.start, s.end, s.added) for s in r.spans)) for r in op6.find(table(spark, rows)).collect()}
    text = rows[0][1]
    mail, phone = "ann at mail7 dot com", "(555) 555-1234"
    assert got == {
        (1, ((0, text.index(mail), text.index(mail) + len(mail), True), (3, text.index(phone), text.index(phone) + len(phone), True))),
        (2, ((0, 2, 8, False), (1, 9, 17, False))), (3, ()), (4, ()), (5, ()), (None, ((0, 100_000, 100_006, False),))}
    assert op6.find(empty(spark)).count() == 0


def test_linked_lines_of_an_article_stay():
    page = "<body><p><a href='/'>Home of the site</a></p><article><h1><a href='/x'>A linked headline</a></h1><p>Some text.</p><nav><a href='/n'>Next</a></nav><p><a href='/y'>A linked paragraph of the article</a></p></article></body>"
    assert op2.main_text(page) == "A linked headline\nSome text.\nA linked paragraph of the article"


def added(text):
    return [(k, text[a:b]) for a, k, b in op6.added_spans([text], [op6.base_spans(text)], op6.trained())[0]]


def test_spelt_out_address_without_digits():
    for text in ("write to ann at example dot com", "please write to ann at example dot com for details", "ann at example dot com", "words before ann (at) example (dot) org words after"):
        assert [k for k, _ in added(text)] == [0], text
    assert added("write to ann at example dot com") == [(0, "ann at example dot com")]
    assert added("he was at home and a dot on the map") == []


def test_spans_across_parts_of_a_long_stretch():
    for n in range(20, 140, 3):  # wherever a part ends
        text = " ".join(["12 of"] * n + ["call", "044", "123", "45", "67", "before", "noon"] + ["12 of"] * 60)
        assert added(text) == [(3, "044 123 45 67")], n


def test_quality_counts(spark):
    rows = [(1, "a b c a b c\nx|y\n\nx|y"), (2, None), (3, ""), (4, "é é é é"), (5, "one"), (5, "one"), (None, "A# b"), (6, sentence(1, 20000))]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) for r in op7.statistics(table(spark, rows)).collect()}
    assert got[1] == (8, 12, 2, 1, 6, 3) and got[2] == got[3] == (0, 0, 0, 0, 0, 0) and got[4] == (4, 4, 0, 0, 4, 1) and got[5] == (1, 3, 0, 0, 0, 1) and got[None] == (2, 3, 1, 0, 0, 1)
    assert got[6][0] == 20000
    assert op7.statistics(empty(spark)).count() == 0


def test_decision_list():
    r = np.random.default_rng(6)
    n = 900
    x = {"symbol_rate": r.random(n), "repeat_rate": r.random(n)}
    bad = (x["symbol_rate"] > 0.8) | ((x["repeat_rate"] > 0.7) & (x["symbol_rate"] < 0.3))
    rules = op7.induce(x, bad, np.arange(n) % 3)
    said = np.zeros(n, bool)
    for rule in rules:
        said |= op7.holds(rule.tests, x)
    assert (said == bad).mean() > 0.97 and len(rules) <= 6
    assert op7.induce(x, np.zeros(n, bool), np.arange(n) % 3) == []


def test_rules_without_labels(spark):
    stats = op7.statistics(table(spark))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert op7.learn(stats, labels) == [] and stats.where(op7.rejected([]) != 0).count() == 0


def test_toxicity(spark):
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        w = sentence(i, 60).split()
        if toxic:
            for k in (5, 25, 45):
                w[k] = ("vile", "nasty", "rotten")[(i + k) % 3]
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "vile nasty"), (1002, "vile nasty"), (None, "plain words only")]
    docs = table(spark, rows)
    y = spark.createDataFrame([*labels, (None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    model = op9.learn(docs, y, train=op9.crc_mod("doc_id", 5) != 0)
    got = op9.score(docs, model)
    assert got.columns == [*docs.columns, "toxicity"] and got.count() == len(rows)
    held = got.where((op9.crc_mod("doc_id", 5) == 0) & (F.col("doc_id") < 400)).select("doc_id", "toxicity").collect()
    assert held and all((r.toxicity >= 0.5) == (r.doc_id % 5 == 0) for r in held)
    s = {r.doc_id: r.toxicity for r in got.where("doc_id >= 1000 OR doc_id IS NULL").collect()}
    assert s[1000] == s[1001] and 0 <= s[1000] < 0.5 and s[1002] >= 0.5 and s[None] < 0.5
    none = op9.learn(docs, y.limit(0))
    assert {r.toxicity for r in op9.score(docs, none).collect()} == {0.0}
    assert op9.score(empty(spark), model).count() == 0


def test_toxic_word_weighs_once():
    # "vile" is toxic only; what follows it is as usual after it, so the pair adds nothing to the second word
    words = {"code": np.array([1, 2], np.uint64), "s": np.array([600, 2000]), "k0": np.array([0, 500]), "k1": np.array([500, 500]), "l0": np.array([0, 1000]), "l1": np.array([600, 1000])}
    pairs = {"a": np.array([1], np.uint64), "b": np.array([2], np.uint64), "n0": np.array([0]), "n1": np.array([60]), "r0": np.array([0.0]), "r1": np.array([59.25])}
    m = op9.estimate(words, pairs, {"k0": 10_000, "k1": 10_000, "t0": 3000, "t1": 3000, "s": 40_000}, 2.0, 0.2, True)
    assert m.word.tolist() == [1] and m.gain[0] > 1 and not len(m.pair)


def test_kneser_ney_against_loops():
    """Continuation counts, absolute discounts and back-off to the shared distribution, word by word."""
    texts_ = {0: ["a b a c", "b c b", "a a b"], 1: ["a x b", "x a x c"]}
    others = ["a b c x d"]
    count = {c: {} for c in (0, 1, "s")}
    for c, part in ((0, texts_[0]), (1, texts_[1]), ("s", texts_[0] + texts_[1] + others)):
        for t in part:
            w = t.split()
            for u, v in set(zip(["<s>", *w], w, strict=False)):
                count[c].setdefault(v, set() if False else []).append(u)
    n = {c: {v: len(x) for v, x in count[c].items()} for c in count}
    total = {c: sum(n[c].values()) for c in n}
    names = sorted(n["s"])

    def p(c, v):
        return max(n[c].get(v, 0) - op9.DISCOUNT, 0) / total[c] + op9.DISCOUNT * len(n[c]) / total[c] * n["s"][v] / total["s"]

    words = {"code": np.arange(1, len(names) + 1, dtype=np.uint64), "s": np.array([n["s"][v] for v in names])} | {f"{x}{c}": np.array([n[c].get(v, 0) for v in names]) for c in (0, 1) for x in "kl"}
    none = {x: np.zeros(0, np.uint64) for x in ("a", "b", "n0", "n1", "r0", "r1")}
    totals = {"s": total["s"]} | {f"k{c}": total[c] for c in (0, 1)} | {f"t{c}": len(n[c]) for c in (0, 1)}
    m = op9.estimate(words, none, totals, -10.0, 0.0)  # every word is an entry
    assert all(abs(sum(p(c, v) for v in names) - 1) < 1e-9 for c in (0, 1))
    assert np.allclose(m.gain, [np.log(p(1, v) / p(0, v)) for v in names])
    got = op9.estimate(words, none, totals, 1e9, 0.0)  # none is: both classes are the shared distribution
    assert not len(got.word) and abs(got.other) < 1e-9


def test_toxicity_counts(spark):
    """What Spark counts, against a loop."""
    rows = [("a b a b", 0), ("a b", 1), ("b", 0), ("", 0), (None, 1), ("a b a b", 0)]
    want = Counter()
    for t, y in rows:
        w = (t or "").split()
        for u, v in set(zip(["", *w], w, strict=False)):
            want[1, v, y] += 1
            want[3, u, y] += 1
    frame = spark.createDataFrame(rows, "_t string, _y int")
    got = frame.mapInArrow(*op9._counts(False)).groupBy("kind", "a", "y").agg(F.sum("n").alias("n")).collect()
    code = {v: int(c.view(np.int64)) for v, c in zip("ab", next(op9.normal_words(np.frombuffer(b"a b", np.uint8), np.array([0, 3])))[1], strict=True)} | {"": 0}
    assert {(r.kind, r.a, r.y): r.n for r in got} == {(k, code[v], y): n for (k, v, y), n in want.items()}


def test_clashing_columns(spark):
    """Columns named like an operator's own, or with a dot."""
    import corpus_pipeline

    odd = ["toxicity", "_deleted", "_lines", "_h", "_i", "_g", "a.b", "_d", "_row", "stays"]
    docs = table(spark, [(i, f"{sentence(i, 30)}\n{sentence(i + 100, 8)}") for i in range(6)])
    for c in odd:
        docs = docs.withColumn(c, F.lit(5))
    y = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, toxic int")
    got = op9.score(docs, op9.learn(docs, y))
    assert sorted(got.columns) == sorted(docs.columns) and got.where("toxicity <= 1").count() == 6
    pages = docs.withColumnRenamed("text", "html")
    assert op2.extract(pages).select("`a.b`", "text").where("`a.b` = 5").count() == 6
    for step in (corpus_pipeline.line_dedup, corpus_pipeline.near_duplicates):
        out = step(spark, docs, "")
        assert out.columns == docs.columns and out.where("_h = 5 AND _i = 5 AND `a.b` = 5").count() == 6
    bench = spark.createDataFrame([(1, "no such words")], "item_id long, text string")
    assert op8.clean(docs, bench).columns == docs.columns


def test_regions_and_names():
    p = "<p>" + "word " * 30 + "</p>"
    long = ("word " * 30).strip()
    assert op2.main_text(f'<body><div class="content no-sidebar">{p}</div></body>') == long
    assert op2.main_text(f'<body><div class="sharing-economy">{p}</div><div class="site-sidebar">{p}</div></body>') == long
    assert op2.main_text(f'<article><div class="article-header"><h1>Head</h1></div>{p}</article>') == f"Head\n{long}"
    linked = "<p>Cf. <a href=x>A&amp;B &ldquo;C&rdquo; and a long title</a></p><p><a>only a link</a></p><p>Last.</p>"
    assert op2.main_text(f"<body>{p}{linked}</body>") == f"{long}\nCf. A&B “C” and a long title\nonly a link\nLast."
    # short lines surge together, and only together; a break of as many links as the window parts regions
    short, menu = "".join(f"<p>line {k} of a short-lined text here</p>" for k in range(4)), "<p><a>link</a></p>" * 4
    page = f"<body><p>one lonely line</p>{menu}{short}{menu}{short}{menu}<p>another lonely line</p></body>"
    want = "\n".join(f"line {k % 4} of a short-lined text here" for k in range(8))
    assert op2.main_text(page) == want and op2.main_text(page, window=1) != want
    assert op2.main_text("<b></i>" * 50_000) == ""


def test_pipeline(spark, tmp_path):
    """The stages over a small folder, against what each must do."""
    import corpus_pipeline

    rows = []
    for i in range(240):
        w = sentence(i, 60).split()
        if i % 6 == 0:
            for k in (5, 25, 45):
                w[k] = ("vile", "nasty", "rotten")[(i + k) % 3]
        rows.append((i, " ".join(w)))
    base = sentence(999, 80).split()
    rows += [(500, " ".join(base)), (501, " ".join([*base[:40], "changed", *base[41:]])), (502, sentence(777, 30) + " " + sentence(888, 14)), (503, None), (504, "")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(240)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, sentence(888, 14))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, str(tmp_path))
        if name != "packing":
            assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    every = {i for i, _ in rows}
    toxic = {i for i in range(240) if i % 6 == 0}
    assert kept["toxicity"] == every - toxic and kept["line_dedup"] == kept["toxicity"]
    assert kept["near_duplicates"] == kept["line_dedup"] - {501}
    assert kept["decontamination"] == kept["packing"] == kept["near_duplicates"] - {502}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
@pytest.mark.parametrize("name", ["op5_substring_dedup", "op8_decontamination", "op10_jaccard_join"])
def test_sql(spark, name):
    import duckdb

    from florilege.llm import catalog

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(catalog.ORACLE[name])
    df = catalog.QUERIES[name](spark, sf).select(*want.columns)
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())


def test_near_duplicates_keep_one_of_each(spark):
    import corpus_pipeline
    from tests.llm.test_joins import brute

    rows = texts()
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, table(spark, rows), "").collect()), key=str)
    group = {i: (n, c) for i, n, c in brute(rows)}
    want = {(i, t) for i, t in rows if not group[i][0]}  # without words: all stay
    for c in {c for n, c in group.values() if n}:
        ids = [(i, t) for i, t in rows if group[i] == (group[i][0], c) and group[i][0]]
        want.add(min(ids, key=lambda x: (x[0] is not None, x[0] or 0)))
    assert got == sorted(want, key=str)


def test_near_duplicates_of_five_words(spark):
    import corpus_pipeline

    base = [f"t{k}" for k in range(1000)]
    far = list(base)
    for k in range(20, 1000, 45):  # 22 scattered changes: similarity 0.80 of five words, below 0.85 of four
        far[k] = f"z{k}"
    rows = [(1, " ".join(base)), (2, " ".join(far)), (3, sentence(3, 60))]
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, table(spark, rows), "").collect()} == {1, 3}


def test_near_duplicates_keep_unlike_null_ids(spark):
    import corpus_pipeline

    rows = [(None, sentence(1, 60)), (None, sentence(2, 60)), (None, sentence(2, 60) + " tail"), (None, None), (4, sentence(3, 60))]
    got = [r.text for r in corpus_pipeline.near_duplicates(spark, table(spark, rows), "").collect()]
    assert len(got) == 4 and {sentence(1, 60), sentence(3, 60), None} < set(got)


LONG = "A paragraph that is long enough to surge over any threshold that a page may have, twice. " * 2


def test_forms_that_frame_a_page():
    login = "<form><label>Name of user</label> <input> <label>Secret word</label> <input> <button>Go</button></form>"
    article = f"<h1>Head</h1><p>{LONG}</p><p>End.</p>"
    want = f"Head\n{LONG.strip()}\nEnd."
    assert op2.main_text(f"<body><form action='/'><nav>Menu</nav><article>{article}</article><footer>f</footer></form></body>") == want
    assert op2.main_text(f"<body><form id='frame'><div class='menu'>Menu</div><div>{article}</div><div class='footer'>f</div></form></body>") == want
    assert op2.main_text(f"<body>{login}<div>{article}</div>{login}</body>") == want
    assert op2.main_text(f"<article>{article}{login}</article>") == want
    long_form = "<form>" + "<p>Tell us what you think about this, in your own words, please, at any length you like to.</p>" * 2 + "</form>"
    assert op2.main_text(f"<div>{article}<p>{LONG}</p><p>{LONG}</p></div>{long_form}") == want + f"\n{LONG.strip()}" * 2
    assert op2.main_text(login) == ""


def test_headers_and_links_of_an_article():
    assert op2.main_text(f"<article><div class='header'><h1>Head</h1></div><p>{LONG}</p></article>") == f"Head\n{LONG.strip()}"
    assert op2.main_text(f"<div class='header'><h1>Site</h1></div><div><p>{LONG}</p></div>") == LONG.strip()
    # without an article element: linked paragraphs and headings at the ends, linked lists between
    assert op2.main_text(f"<div><h1><a href='/'>Head</a></h1><p>{LONG}</p><p><a href='/x'>Read the paper itself</a></p></div>") == f"Head\n{LONG.strip()}\nRead the paper itself"
    items = "".join(f"<li><a href='/{k}'>Thing {k}</a></li>" for k in range(3))
    assert op2.main_text(f"<p>{LONG}</p><h2>Things</h2><ul>{items}</ul><p>{LONG}</p>") == "\n".join([LONG.strip(), "Things", *(f"Thing {k}" for k in range(3)), LONG.strip()])
    assert op2.main_text(f"<ul>{items * 3}</ul><div><p>{LONG}</p></div><ul>{items * 3}</ul>") == LONG.strip()


def test_windows_decide_where_no_name_helps():
    """A page without class names and sectioning elements: short unmarked link lists around the text are left to the windows."""
    links = "".join(f"<div><a href='/{k}'>Topic {k}</a></div>" for k in range(9))
    page = f"<div>{links}</div><div><div>{LONG}</div><div>Short.</div><div>{LONG}</div></div><div>{links}</div>"
    kept = f"{LONG.strip()}\nShort.\n{LONG.strip()}"
    assert op2.main_text(page) == kept
    lines, _, _, outside, *_ = op2.lines_of(page)
    assert len(lines) == 21 and not any(outside)


def test_likelihood_and_viterbi_against_enumeration():
    """The partition sum, its gradients and the best path, over all label sequences of short ones."""
    import itertools

    r = np.random.default_rng(4)
    L, T, n, k = len(op6.LABELS), 3, 3, 4
    on = np.array([[True] * 3, [True, True, False], [True, False, False]])
    where = tuple(np.array(x) for x in zip(*[(b, t, f) for b in range(n) for t in range(T) if on[b, t] for f in range(k) if r.random() < 0.6], strict=True))
    params = [r.normal(size=(k, L)), r.normal(size=(L, L)), r.normal(size=L)]
    y = r.integers(0, L, (n, T)) * on

    def plain(params):
        W, M, S = params
        total = 0.0
        for b in range(n):
            e = np.zeros((T, L))
            for i, t, f in zip(*where, strict=True):
                if i == b:
                    e[t] += W[f]
            size = int(on[b].sum())

            def value(path):
                return S[path[0]] + sum(e[t][c] for t, c in enumerate(path)) + sum(M[a, c] for a, c in zip(path, path[1:], strict=False))

            every = [value(p) for p in itertools.product(range(L), repeat=size)]
            total += value(y[b, :size].tolist()) - np.log(np.exp(every).sum())
        return total

    got, grads = op6.likelihood(params, where, on, y)
    assert got == pytest.approx(plain(params), abs=1e-9)
    for i, g in enumerate(grads):
        for at in [tuple(r.integers(0, s) for s in g.shape) for _ in range(8)]:
            near = []
            for step in (1e-5, -1e-5):
                moved = [p.copy() for p in params]
                moved[i][at] += step
                near.append(plain(moved))
            assert g[at] == pytest.approx((near[0] - near[1]) / 2e-5, abs=1e-5)
    model = op6.Crf({f"f{f}": f for f in range(k)}, *params)
    rows = [[[f"f{f}" for i, u, f in zip(*where, strict=True) if i == b and u == t] for t in range(int(on[b].sum()))] for b in range(n)]
    for row, path in zip(rows, model.viterbi(rows), strict=True):
        def score(p, row=row):
            return params[2][p[0]] + sum(params[0][int(f[1:])][c] for c, fs in zip(p, row, strict=True) for f in fs) + sum(params[1][a, c] for a, c in zip(p, p[1:], strict=False))
        best = max(itertools.product(range(L), repeat=len(row)), key=score)
        assert tuple(path) == best


#: sentences whose words are not those of the training frames: text, and what the model must add
UNSEEN = [
    ("Questions go to nora (at) riverbank.org as before", ["nora (at) riverbank.org"]), ("you may write peter at lakeside.net tomorrow", ["peter at lakeside.net"]), ("or drop a note: h.meier [at] uni dot ch", ["h.meier [at] uni dot ch"]),
    ("sales @ bigshop . com answers within a day", ["sales @ bigshop . com"]), ("anna dot", []), ("ann at example dot com will know", ["ann at example dot com"]), ("London office 020 7946 0958, second floor", ["020 7946 0958"]),
    ("He dialled (212) 555-0147 twice", ["(212) 555-0147"]), ("Fax: 044 123 45 67", ["044 123 45 67"]), ("my phone is 415-555-2671 now", ["415-555-2671"]), ("the old number 0041 44 668 18 00 rings", ["0041 44 668 18 00"]), ("charged to 4111.1111.1111.1111 in May", ["4111.1111.1111.1111"]),
    ("in the range 100-200-3000 km of road", []), ("your order 123 456 78 90 has left us", []), ("Invoice 044 123 45 67 was paid", []), ("ISBN 978-3-16-148410-0 is sold out", []), ("the exhibition at museum.org was nice", []), ("we met at 10.30 and left at 12.15", []),
    ("born on 1984-10-12 in a town of 12 000 people", []), ("version 1.20.3 of the tool", []), ("pages 100 200 300 are lost", []), ("look at example.com for news", []), ("it was at home.", []), ("scores of 12-3 and 11-4", []), ("π is 3.14159 26535 89793", []), ("lot 12, row 345-67 at the back", []),
]


def test_added_spans_in_unseen_sentences():
    model = op6.trained()
    found = want = right = 0
    for text, due in UNSEEN:
        got = [text[a:b] for a, _, b in op6.added_spans([text], [op6.base_spans(text)], model)[0]]
        found, want, right = found + len(got), want + len(due), right + len(set(got) & set(due))
    assert right >= 0.9 * want and right >= 0.9 * found, (found, want, right)


def test_learning_is_the_same_however_rows_are_joined(spark, monkeypatch):
    """Repeated rows count once with labels that are broadcast and with labels that are shuffled, and as if they stood there once."""
    rows = [(i, f"{sentence(i, 20)} {'grim foul words here' if i % 3 == 0 else 'calm'} {sentence(i + 300, 6)}") for i in range(90)]
    y = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    said = []
    for few, docs in ((op9.FEW, rows), (op9.FEW, rows + rows[:45] * 3), (10, rows + rows[:45] * 3)):
        monkeypatch.setattr(op9, "FEW", few)
        m = op9.learn(table(spark, docs), y)
        said.append((m.word.tolist(), m.gain.tolist(), m.other, m.slope, m.shift))
    assert said[1][0] == said[2][0] and said[1][1] == pytest.approx(said[2][1]) and said[1][2:] == pytest.approx(said[2][2:])  # sums of floats in another order

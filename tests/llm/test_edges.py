"""Operators against plain loops on random texts, very long texts, and the pipeline's edge cases."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from florilege.llm import op2_extraction as op2
from florilege.llm import op3_line_dedup as op3
from florilege.llm import op6_pii as op6
from florilege.llm import op7_quality as op7
from florilege.llm import op8_decontamination as op8
from florilege.llm import op9_toxicity as op9
from florilege.llm import op10_jaccard_join as op10
from tests.llm.fixtures import sentence, table

tokenizers = pytest.importorskip("public_tokenizers")


def due_lines(rows):
    """Per document its lines that an earlier document has, too: in a row with a neighbour or of seven words and more
    (they must go), and of five or six words (they may)."""
    lines, pairs, out = set(), set(), {}
    for i, text in rows:
        ink = [x.strip() for x in text.split("\n") if x.strip()]
        must, may = set(), set()
        for k in range(len(ink) - 1):
            if (ink[k], ink[k + 1]) in pairs:
                must |= {k, k + 1}
        for k, x in enumerate(ink):
            if x in lines:
                (must if len(x.split()) >= 7 else may if len(x.split()) >= 5 else set()).add(k)
        out[i] = Counter(ink[k] for k in must), Counter(ink[k] for k in may - must)
        lines |= set(ink)
        pairs |= set(zip(ink, ink[1:], strict=False))
    return out


def test_line_dedup_against_brute_force(spark):
    r = random.Random(12)
    pool = [" ".join(f"v{r.randrange(300)}" for _ in range(r.choice((1, 2, 3, 5, 8, 12)))) for _ in range(400)]
    blocks = [[r.choice(pool) for _ in range(r.randint(2, 7))] for _ in range(60)]
    rows = []
    for i in range(400):
        ink = []
        for _ in range(r.randint(1, 6)):
            ink += r.choice(blocks) if r.random() < 0.4 else [f"own {i} {r.randrange(10**6)} of it"]
        rows.append((i, "\n".join(ink)))
    due = due_lines(rows)
    want = caught = 0
    for x in op3.line_dedup(table(spark, rows)).collect():
        must, may = due[x.doc_id]
        gone = Counter(y.strip() for y in dict(rows)[x.doc_id].split("\n")) - Counter(y.strip() for y in x.text.split("\n"))
        assert not gone - must - may, x.doc_id  # nothing else goes
        want += sum(must.values())
        caught += sum((must & gone).values())
    assert want > 500 and caught >= 0.9 * want, (caught, want)


def plain_counts(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    spots = {}
    for k in range(len(ws) - 2):
        spots.setdefault(tuple(ws[k : k + 3]), []).append(k)
    again = {k + j for at in spots.values() if len(at) > 1 for k in at for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again)


def test_quality_counts_against_brute_force(spark):
    r = random.Random(3)
    signs = ["a", "b", "é", "日本", "#", "*x", "|", " ", "\n", "\n", "\t", "\x0b", "\x85", " ", "😀", "a b a", "\r\n"]
    rows = [(i, "".join(r.choice(signs) + (" " if r.random() < 0.6 else "") for _ in range(r.randint(0, 60)))) for i in range(300)] + [(900, None), (901, "\n\n"), (902, "x y z " * 9000)]
    got = {x.doc_id: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in op7.statistics(table(spark, rows)).collect()}
    assert got == {i: plain_counts(t) for i, t in rows}


def test_a_text_of_five_megabytes(spark):
    """One very long text beside usual ones: each operator takes it whole."""
    r = random.Random(5)
    body = "\n".join(" ".join(f"w{r.randrange(10**5)}" for _ in range(40)) for _ in range(19_000))
    tail = "write to ann.b@example.org or 10.20.30.40 at last"
    long = f"{body}\n{tail}"
    assert len(long) > 5_000_000
    rows = [(1, sentence(1)), (2, long), (3, body.split("\n")[18_990] + "\n" + body.split("\n")[18_991] + "\nown end"), (4, long + " more")]
    docs = table(spark, rows)
    got = {x.doc_id: (x._deleted, x.text) for x in op3.line_dedup(docs).collect()}
    assert got[2][0] == 0 and got[3] == (2, "own end") and got[4] == (19_000, tail + " more")
    spans = {x.doc_id: [long[s.start : s.end] for s in x.spans] for x in op6.find(docs).where("doc_id = 2").collect()}
    assert {"ann.b@example.org", "10.20.30.40"} <= set(spans[2])
    assert {x.doc_id: x.n_words for x in op7.statistics(docs).collect()}[2] == len(long.split())
    bench = spark.createDataFrame([(1, " ".join(body.split("\n")[18_998].split()[:12]))], "item_id long, text string")
    assert {x.doc_id for x in op8.contamination(docs, bench).where("size(spans) > 0").collect()} == {2, 4}
    assert {x.doc_id: x.component_id for x in op10.jaccard_components(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 2}
    y = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, toxic int")
    assert op9.score(docs, op9.learn(docs, y)).where("toxicity between 0 and 1").count() == 4
    page = "<article>" + "".join(f"<p>{x}</p>" for x in body.split("\n")) + "</article>"
    assert op2.main_text(page) == body


def through(spark, tmp_path, docs, name):
    """The pipeline's result and the columns after each stage but the last."""
    import corpus_pipeline

    at = f"{tmp_path}/{name}"
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "words of a question that no document holds at all here")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return corpus_pipeline.run(spark, at)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    got = through(spark, tmp_path, table(spark, []), "none")
    assert got.count() == 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns)


def test_pipeline_of_repeated_rows_and_clashing_columns(spark, tmp_path):
    # four labels teach nothing, so no document goes as toxic
    rows = [(i, sentence(i, 50)) for i in range(40)] + [(5, sentence(5, 50))] * 3 + [(60, None), (61, ""), (61, ""), (None, sentence(70, 50))]
    docs = table(spark, rows)
    for c in ("toxicity", "_deleted", "_lines", "_h", "_i", "_g", "a.b", "_row", "piece", "sequence_id", "stays"):
        docs = docs.withColumn(c, F.lit("z"))
    got = Counter(x.doc_id for x in through(spark, tmp_path, docs, "odd").select("doc_id").collect())
    assert got == Counter([*range(40), 60, 61, 61, None])


def test_repeats_and_packing_of_a_text_of_five_megabytes(spark):
    from tokenizers import Tokenizer

    from florilege.llm import op1_packing as op1
    from florilege.llm import op4_suffix_dedup as op4
    from florilege.llm import op5_substring_dedup as op5

    r = random.Random(8)
    words = [f"w{r.randrange(10**6)}x" for _ in range(640_000)]
    long = " ".join(words)
    assert len(long) > 5_000_000
    rows = [(1, long), (2, "front " + " ".join(words[500_000:500_060]) + " end"), (3, sentence(1, 50))]
    docs = table(spark, rows).withColumns({c: F.lit("z") for c in ("kept", "spans", "n_words", "a.b", "piece")})
    assert {x.doc_id: [tuple(s) for s in x.spans] for x in op5.substring_dedup(docs).collect()} == {1: [(500_000, 500_060)], 2: [(1, 61)], 3: []}
    shared = (" " + " ".join(words[500_000:500_060]) + " ").encode()
    at = long.encode().index(shared)
    assert {x.doc_id: [tuple(s) for s in x.spans] for x in op4.suffix_dedup(docs).collect()} == {1: [(at, at + len(shared))], 2: [(5, 5 + len(shared))], 3: []}
    path = tokenizers.path("word_bpe_49k.json")
    got = op1.pack(docs, path).where("doc_id = 1").agg(F.sum("length").alias("n"), F.max("length").alias("most")).first()
    assert got.n == len(Tokenizer.from_file(path).encode(long, add_special_tokens=False).ids) + 1 and got.most == 2048


def test_quality_and_windows_of_empty_and_clashing_tables(spark):
    from florilege.llm import op5_substring_dedup as op5

    none = table(spark, [])
    assert op7.statistics(none).count() == op5.substring_dedup(none).count() == 0
    docs = table(spark, [(1, "a b c"), (1, "a b c"), (None, None)]).withColumns({c: F.lit("z") for c in ("n_words", "word_chars", "_h", "kept", "anchor", "a.b")})
    assert Counter((x.doc_id, x.n_words) for x in op7.statistics(docs).collect()) == {(1, 3): 2, (None, 0): 1}
    assert Counter((x.doc_id, x.kept) for x in op5.substring_dedup(docs, window=3).collect()) == {(1, ""): 2, (None, ""): 1}

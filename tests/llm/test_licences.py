"""Licence scans: the automaton against plain substring search, base columns against a loop, spans of planted texts."""

import random
import re

from pyspark.sql import functions as F

from florilege.llm import op11_licences as op11
from florilege.llm.licences import PHRASES, TEMPLATES
from tests.llm.fixtures import empty, sentence, table, texts


def occurs(piece, s):
    return [i for i in range(len(s) - len(piece) + 1) if s[i : i + len(piece)] == piece]


def test_automaton_against_substrings():
    r = random.Random(1)
    for _ in range(60):
        strings = [[r.randrange(3) for _ in range(r.randint(0, 12))] for _ in range(r.randint(1, 5))]
        a = op11.Automaton(strings)
        text = [r.randrange(4) for _ in range(40)]
        v = n = 0
        for i, c in enumerate(text):
            v, n = a.step(v, n, c)
            want = max((k for k in range(i + 2) if any(occurs(text[i + 1 - k : i + 1], s) for s in strings)), default=0)
            assert n == want
            ends = {t for t in a.whole[v] if len(strings[t]) <= n}
            assert ends == {t for t, s in enumerate(strings) if s and text[: i + 1][-len(s) :] == s}
            got = {(t, e): min(n, m) for t, e, m in a.near(v, 1)} if n else {}
            for t, s in enumerate(strings):
                for e in range(len(s)):
                    m = 0
                    while m <= min(i, e) and text[i - m] == s[e - m]:
                        m += 1
                    assert got.get((t, e), 0) == m


def test_matches_against_diagonals():
    """Maximal matches of every template, also where another template matches longer."""
    r = random.Random(2)
    for _ in range(40):
        pool = [f"v{k}" for k in range(5)]
        templates = [("x", " ".join(r.choice(pool) for _ in range(r.randint(1, 15)))) for _ in range(4)]
        scanner = op11.Scanner(templates, [], least=3)
        ws = [r.choice([*pool, "other"]) for _ in range(80)]
        for part in (1, 7, 1000):
            n, whole, got = scanner.read(" ".join(ws).encode(), part)
            assert n == 80
            want = set()
            for t, (_, s) in enumerate(templates):
                s = s.split()
                for i in range(80):
                    for k in range(len(s)):
                        if ws[i] == s[k] and (i == 0 or k == 0 or ws[i - 1] != s[k - 1]):
                            m = 0
                            while i + m < 80 and k + m < len(s) and ws[i + m] == s[k + m]:
                                m += 1
                            if m >= 3:
                                want.add((t, i, k, m))
            assert set(got) == want and len(got) == len(set(got))
            assert sorted(whole) == sorted((t, i) for t, (_, s) in enumerate(templates) for i in occurs(s.split(), ws))


def plain_base(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for p, label in PHRASES for i in occurs(p.split(), ws)]
    return len(ws), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))


ODD = ["CC BY cc-by cc_by ccby CC\nBY", "All rights reserved. all RIGHTS reserved", "General Public\tLicense général public license", "cc cc by by", "CC‐BY cc by", "ALL RİGHTS reserved", "all rights reserved" * 3, "K cc by"]


def test_base_against_loop(spark, tmp_path):
    rows = texts() + [(50 + k, t) for k, t in enumerate(ODD)] + [(200, sentence(3, 50_000) + " cc by " + sentence(4, 60_000) + " General Public License")]
    docs = table(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in op11.query(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(((i, *plain_base(t)) for i, t in rows), key=str)
    assert op11.scan(empty(spark)).count() == 0
    clash = docs.withColumns({c: F.lit("z") for c in ("base", "spans", "score", "a.b")})
    assert op11.scan(clash).count() == len(rows)


def test_planted_licences(spark):
    full = {}
    for label, text in TEMPLATES:
        full[label] = max(full.get(label, ""), text, key=len)
    r = random.Random(3)
    rows, want = [], {}
    for k, (label, text) in enumerate(full.items()):
        ws = text.split()
        if len(ws) > 30:  # a name filled in, two words changed, one line lost
            for _ in range(2):
                ws[r.randrange(len(ws))] = "changed"
            cut = r.randrange(len(ws) - 5)
            del ws[cut : cut + 5]
            ws.insert(len(ws) // 2, "Example Company and its heirs")
        rows.append((k, sentence(k, 60) + "\n# " + "\n * ".join(ws) + "\n" + sentence(k + 100, 60)))
        want[k] = label
    rows += [(100 + k, sentence(k, 300)) for k in range(20)] + [(200, "Permission is hereby granted to no one. The software is provided by us, without warranty of course, and the use of it is free of charge.")]
    got = {x.doc_id: x for x in op11.scan(table(spark, rows)).collect()}
    found = {k: {s.label for s in got[k].spans} for k in got}
    assert {k: found[k] for k in want} == {k: {v} for k, v in want.items()}
    assert all(got[k].score >= 0.75 for k in want)
    assert not any(found[k] for k in found if k >= 100) and all(got[k].score == 0 for k in range(100, 120)) and got[200].score < 0.5


def test_short_notices(spark):
    said = {
        "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under CC BY 4.0.": "cc-by", "Licensed under CC BY-SA 4.0.": "cc-by-sa",
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0", "licensed under the GNU General Public License, version 2": "gpl-2.0", "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause", "a Creative Commons Attribution-ShareAlike License": "cc-by-sa",
        "The apache is licensed, and MIT has a license; terms of use, all rights.": None,
    }
    rows = [(k, f"{sentence(k, 9)} {t}") for k, t in enumerate(said)]
    got = {x.doc_id: [s.label for s in x.spans] for x in op11.scan(table(spark, rows)).collect()}
    assert got == {k: [x] if x else [] for k, x in enumerate(said.values())}

"""Fill-in-the-middle against plain string slices, conversation repair against all sequences of edits."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from florilege.llm import op12_fill_in_middle as op12
from florilege.llm import op13_conversation_repair as op13
from tests.llm.fixtures import empty, sentence, table, texts


def plain_turn(i, t, marks=("<P>", "<S>", "<M>")):
    t = t or ""
    code = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(code[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    if not t or any(m in t for m in marks) or h[2] % 100 >= 90:
        return len(t), "plain", None, None, t
    p, s, m = marks
    out = f"{s}{t[b:]}{p}{t[:a]}{m}{t[a:b]}" if h[3] % 100 < 20 else f"{p}{t[:a]}{s}{t[b:]}{m}{t[a:b]}"
    return len(t), "spm" if h[3] % 100 < 20 else "psm", a, b - a, out


def test_fill_in_middle_against_slices(spark):
    odd = [(30 + k, t) for k, t in enumerate(["x<P>y", "a<S>", "<M>", "<P", "S>", "<<SS>>", "😀é\U0010ffff", "é‍", "a\r\n\nb", "\x00\x01"])]
    rows = texts() + odd + [(100 + k, "<M" + sentence(k, k % 9) + ">") for k in range(300)] + [(999, "é😀 x" * 400_000)]
    got = op12.fill_in_middle(table(spark, rows)).withColumn("back", op12.restored("output", "form")).collect()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=str) == sorted(((i, *plain_turn(i, t)) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.back) for r in got), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert op12.fill_in_middle(empty(spark)).count() == 0


def test_fill_in_middle_other_columns_and_marks(spark):
    rows = [(k, sentence(k, 12)) for k in range(60)]
    docs = table(spark, rows).withColumns({c: F.lit("z") for c in ("output", "form", "_r", "a.b", "n_")})
    marks = ("[[pre]]", "[[suf]]", "[[mid]]")
    got = op12.fill_in_middle(docs, seed=7, marks=marks, plain=0, spm=100).withColumn("back", op12.restored("output", "form", marks)).collect()
    assert {r.form for r in got} == {"spm"} and {r.doc_id: r.back for r in got} == dict(rows)


def test_units(spark):
    import numpy as np

    def cut(t, unit):
        at = op12.boundaries(np.frombuffer(t.encode("utf-32-le"), np.dtype("<u4")), unit)
        return [t[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    assert cut("ab c", "char") == ["a", "b", " ", "c"]
    assert cut("ab  ç\n日本", "word") == ["ab", "  ", "ç", "\n", "日本"]
    assert cut("a b\n\nc\nd", "line") == ["a b\n", "\n", "c\n", "d"]
    assert cut("", "word") == [] and cut("x", "line") == ["x"]
    rows = [(k, sentence(k, 30)) for k in range(80)]
    for r in op12.fill_in_middle(table(spark, rows), unit="word", plain=0).collect():
        t = dict(rows)[r.doc_id]
        ends = [r.prefix_chars, r.prefix_chars + r.middle_chars]
        assert all(c in (0, len(t)) or t[c - 1].isspace() != t[c].isspace() for c in ends)


SCHEMA = "conv_id long, turn long, role string, text string, _c string, audit int"


def damage(rows):
    """The contract's damage by plain loops."""
    out = []
    for c, n, r, t in rows:
        c2, n2, r, t = (" " if x is None else x for x in (c, n, r, t))
        x = zlib.crc32(f"{c2}:{n2}".encode()) % 20
        if x:
            t = "" if x == 1 else re.sub("[.!?]", "", t) if x == 2 else t
            out += [(c, n, "user" if x == 4 else r, t)] * (2 if x == 3 else 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2], hashlib.md5(x[3].encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, _, r, t in rows:
        ink = t.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not ink else "duplicate" if (r, t) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((r, t))
    return out


def cheapest(rows, marks):
    """Every sequence of edits with insertions between, by brute force: the least (cost, audit) and its turns."""
    best = (2 * len(rows), "D" * len(rows), [])  # all deleted

    def go(i, cost, audit, done, idle):
        nonlocal best
        if cost > best[0] or not re.fullmatch("s?(ua)*u?", "".join(r[:1] or "-" for r, _ in done)):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in done)):
            best = min(best, (cost, audit, done))
        if idle < 3:
            for r in ("user", "assistant"):
                go(i, cost + 5, audit + "I", [*done, (r, "")], idle + 1)
        if i < len(rows):
            _, _, role, text = rows[i]
            go(i + 1, cost + 2, audit + "D", done, 0)
            if marks[i] not in ("blank", "duplicate"):
                more = 5 * (marks[i] == "truncated")
                go(i + 1, cost + more, audit + "K", [*done, (role, text)], 0)
                for r in ("user", "assistant"):
                    go(i + 1, cost + 1 + more, audit + "R", [*done, (r, text)], 0)

    go(0, 0, "", [], 0)
    return best


def expected(rows):
    """The report of one conversation, from its rows after damage."""
    rows = in_order(rows)
    marks, numbers = faults(rows), [n for _, n, _, _ in rows if n is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    heads = [r[:1] for _, _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:], strict=False))
    cost, audit, done = cheapest(rows, marks)
    text = "\n".join(f"{r}:{t}" for r, t in done)
    return gaps, *(marks.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def conversations(seed, n, most=5):
    r = random.Random(seed)
    says = ["Yes.", "No", " ", "", "What?", "Well.\n", "Ends (here)", "Yes.", None, "\x0b.\t"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "sage", "umpire"]
    return [(None if c == 3 else c, None if r.random() < 0.1 else k, r.choice(roles), r.choice(says)) for c in range(n) for k in r.choices(range(7), k=r.randint(1, most))]


def test_repair_against_all_edits(spark, tmp_path):
    rows = conversations(4, 120)
    docs = spark.createDataFrame([(*x, "z", 1) for x in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x.conv_id: tuple(x)[1:] for x in op13.query(spark, str(tmp_path)).collect()}
    spoilt = damage(rows)
    assert got == {c: expected([x for x in spoilt if x[0] == c]) for c in {x[0] for x in rows}}
    assert set("".join(x[6] for x in got.values())) == set("DKR")  # deleting a turn is always cheaper than inserting one


@pytest.mark.parametrize("segment", [1, 2, 3])
def test_repair_in_segments(spark, segment):
    """Conversations that are cut anywhere are repaired as those that aren't."""
    rows = conversations(9, 25, most=9) + [(900, k, ("user", "assistant", "tool")[k * k % 3], f"t {k % 17}" + ".?,"[k % 3]) for k in range(150)]
    docs = op13.turns(spark.createDataFrame([(*x, "z", 1) for x in rows], SCHEMA))
    whole, cut = op13.repair(docs), op13.repair(docs, segment)
    assert sorted(map(str, whole.report.collect())) == sorted(map(str, cut.report.collect()))
    assert sorted(map(str, op13.hashed(op13.rebuilt(docs, whole.acts)).collect())) == sorted(map(str, op13.hashed(op13.rebuilt(docs, cut.acts)).collect()))


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hm?"), (1, 2, "user", "Who?"), (1, 4, "assistant", "I"), (2, 0, "assistant", "Hello."), (2, 1, "user", "And?"), (3, 0, "user", "x" * 3_000_000 + ".")]
    docs = op13.turns(spark.createDataFrame([(*x, "z", 1) for x in rows], SCHEMA))
    fixed = op13.repair(docs)
    turns = {}
    for x in op13.rebuilt(docs, fixed.acts).collect():
        turns.setdefault(x._c, []).append((x.role, x.text[:9]))
    assert turns[1] == [("system", "Be brief."), ("user", "Hm?"), ("assistant", "Who?")]
    assert turns[2] == [("user", "Hello."), ("assistant", "And?")]
    assert 3 not in turns
    assert {x._c: (x.gaps, x.cost, x.audit) for x in fixed.report.collect()} == {1: (1, 3, "KKRD"), 2: (0, 2, "RR"), 3: (0, 2, "D")}


def test_insertions_where_they_are_cheap(spark, monkeypatch):
    """At the contract's prices no insertion pays; at others the walk, the audit and the turns must agree."""
    monkeypatch.setattr(op13, "DELETE", 9)
    monkeypatch.setattr(op13, "REROLE", 9)
    monkeypatch.setattr(op13, "INSERT", 1)
    monkeypatch.setattr(op13, "END", op13.closed([0, op13.FAR, op13.FAR, 0]))
    for roles, audit, left in (("uu", "KIKI", "uaua"), ("aa", "IKIK", "uaua"), ("s", "KII", "sua"), ("sa", "KIK", "sua"), ("ua", "KK", "ua")):
        initials = ["sua".index(x) for x in roles]
        togo = op13.costs(initials, [0] * len(roles), op13.END)
        assert op13.walk(initials, [0] * len(roles), togo, 0, True)[0] == audit
        rows = spark.createDataFrame([(1, k, {"s": "system", "u": "user", "a": "assistant"}[x], f"t{k}.") for k, x in enumerate(roles)], "_c long, _n long, _r string, _t string")
        cut = re.findall("I*[DKR](?:I+$)?", audit)
        acts = rows.orderBy("_n").collect()
        acts = spark.createDataFrame([(x._c, x._n, x._r, hashlib.md5(x._t.encode()).hexdigest(), a) for x, a in zip(acts, cut, strict=True)], "_c long, _n long, _r string, _d string, _act string")
        assert "".join(x.role[0] for x in op13.rebuilt(rows, acts).collect()) == left


def test_repair_of_nothing_and_of_copies(spark, tmp_path):
    none = op13.turns(spark.createDataFrame([], SCHEMA))
    assert op13.repair(none).report.count() == 0
    many = op13.turns(spark.createDataFrame([(1, 5, "user", "Same.", "", 1)] * 500 + [(1, 6, "assistant", "Right.", "", 1)] * 3, SCHEMA))
    fixed = op13.repair(many)
    assert [tuple(x) for x in fixed.report.collect()] == [(1, 0, 0, 501, 0, 501, 1002, "K" + "D" * 499 + "KDD")]
    spark.createDataFrame([(8, t, "user", "gone", "", 1) for t in range(400) if zlib.crc32(f"8:{t}".encode()) % 20 == 0], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(x) for x in op13.query(spark, str(tmp_path)).collect()] == [(8, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]

"""Affix dictionaries against forms written out by hand, and against a plain loop."""

from florilege.operators import detectors
from florilege.sources import spelling

SINGLE = """SET UTF-8
FORBIDDENWORD !
SFX S Y 4
SFX S 0 s [^sy]
SFX S y ies [^aeiou]y
SFX S 0 es s
SFX S 0 s [aeiou]y
SFX D N 1
SFX D e ing/S e
PFX U Y 1
PFX U 0 un .
PFX N N 1
PFX N 0 non- .
"""
LONG = """FLAG long
NEEDAFFIX ()
CIRCUMFIX **
SFX a0 Y 2
SFX a0 er es/E'() er
SFX a0 er ons er
SFX g0 Y 1
SFX g0 0 t/** .
PFX E' Y 1
PFX E' 0 l' [aeiou]
PFX ge Y 1
PFX ge 0 ge/** .
"""


def words(spark, tmp_path, **files):
    for name, text in files.items():
        stem, end = name.rsplit("_", 1)
        (tmp_path / f"{stem}.{end}").write_text(text)
    got = {}
    for r in spelling.lexicon(spark, f"{tmp_path}/*.aff", f"{tmp_path}/*.dic").collect():
        got.setdefault(r.lang, []).append(r.word)
    assert all(len(x) == len(set(x)) for x in got.values())
    return {k: set(v) for k, v in got.items()}


def test_rules(spark, tmp_path):
    stems = "8\nhappy/US\tpo:adj\nbake/DN\nbus/S\nday/S\nplain\nbad/!\nand\\/or\n42/S\n\n"
    got = words(spark, tmp_path, en_aff=SINGLE, en_dic=stems, fr_aff=LONG, fr_dic="3\naimer/a0E'\nchanter/a0\nmach/g0ge\nsoi/()E'\n", xx_dic="1\nlone/QQ po:x\n")
    assert got["en"] == {
        "happy", "happies", "unhappy", "unhappies",  # both classes combine
        "bake", "baking", "bakings", "non-bake",  # a suffix on a suffix; a prefix that doesn't combine
        "bus", "buses", "day", "days", "plain", "and/or", "42", "42s",
    }
    # "aimes" needs a prefix of its own, "macht" the other side of its circumfix
    assert got["fr"] == {"aimer", "l'aimer", "l'aimes", "aimons", "l'aimons", "chanter", "chantons", "mach", "gemacht"}
    assert got["xx"] == {"lone"}


def test_missing_files(spark, tmp_path):
    assert spelling.lexicon(spark, f"{tmp_path}/*.aff", f"{tmp_path}/*.dic").count() == 0
    assert words(spark, tmp_path, de_dic="1\nwort/AB\n") == {"de": {"wort"}}


def test_numbers_and_full_strip(spark, tmp_path):
    got = words(spark, tmp_path, it_aff="FLAG num\nFULLSTRIP\nSFX 10 Y 1\nSFX 10 ha avere ha\nSFX 11 Y 1\nSFX 11 0 -lo [a-]\n", it_dic="2\nha/10,11\nve-/11\n")
    assert got == {"it": {"ha", "avere", "ha-lo", "ve-", "ve--lo"}}
    assert words(spark, tmp_path, it_aff="SFX A Y 1\nSFX A ha avere ha\n", it_dic="1\nha/A\n") == {"it": {"ha"}}


def test_capitals(spark):
    lex = spark.createDataFrame([("de", "haus"), ("de", "Berlin"), ("en", "IBM")], "lang string, word string")
    docs = spark.createDataFrame([(1, "Haus HAUS haus hAus berlin BERLIN Ibm IBM")], "id int, text string")
    got = {r.word: (r.n, r.langs) for r in detectors.accepted(docs, "id", lex, capitals=True).collect()}
    assert {w for w, (_, x) in got.items() if x} == {"Haus", "HAUS", "haus", "BERLIN", "IBM"} and len(got) == 8
    assert {r.word for r in detectors.accepted(docs, "id", lex).where("size(langs) > 0").collect()} == {"haus", "IBM"}
    assert [round(r.score, 3) for r in detectors.coverage(docs, "id", lex, capitals=True).orderBy("lang").collect()] == [0.8, 0.2]

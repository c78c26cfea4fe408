"""Golden cases of the text functions, worked out by hand from the rules."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from florilege.functions import grams, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f("t").alias("r")).first()["r"]


@pytest.mark.parametrize(("given", "wanted"), [
    ("&lt;b&gt;Bun di&lt;/b&gt;", "Bun di"), ("1 000 ½ m²", "$NUM$ $NUM$ $NUM$⁄$NUM$ m$NUM$"), ("so­ft z​w", "soft zw"), ("ạb", "ab"), ("a b", "ab"),
    ("see https://x.ch/12?a=3, www.rtr.ch.", "see $URL$ $URL$"), ("x…y", "x...y"), ("ﬁn", "fin"), ("٣", "$NUM$"), ("AT&amp;T &nbsp; x", "AT&T x"), (None, None), ("", ""),
])
def test_normalize(spark, given, wanted):
    assert one(spark, given, text.normalize) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("1) Legia", "$NUM$) Legia"), ("a) Legia 2a) scriva c) fa", "Legia $NUM$a) scriva fa"), ("Legia ____ e ..... fin…", "Legia  e  fin")])
def test_textbook(spark, given, wanted):
    assert one(spark, given, text.textbook) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("Fin. (cdm/fmr)", "Fin."), ("x (a/b/c) ", "x"), ("Fin. (fmr)", "Fin. (fmr)"), ("Fin. (CDM/fmr)", "Fin. (CDM/fmr)"), ("A (a/b) fin", "A (a/b) fin")])
def test_signature(spark, given, wanted):
    assert one(spark, given, text.strip_signature) == wanted


@pytest.mark.parametrize(("given", "wanted"), [
    ("Ils $NUM$ s-chelins - ch'el, l’autra!", "ils s-chelins ch'el l autra"), ("-a- b-", "a b"), ("$NUM$.", ""), ("a--b", "a--b"), ("under_score", "under_score")])
def test_clean(spark, given, wanted):
    assert one(spark, given, text.clean_for_training) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("A b. C d! E? F", ["A b.", "C d!", "E?", "F"]), ("a.b. c", ["a.b.", "c"]), ("a...  b", ["a...", "b"])])
def test_sentences(spark, given, wanted):
    assert one(spark, given, text.sentences) == wanted


def test_mask_keeps_order(spark):
    from florilege.operators.foreign import ALLOWED

    assert one(spark, "Jörger", lambda c: text.mask(c, ALLOWED)) == "$NE$er"


def test_marks_overlap(spark):
    assert one(spark, " ho ho ", lambda c: F.round(text.share_of(c, [" ho "]), 3)) == pytest.approx(57.143)
    assert one(spark, "", lambda c: text.share_of(c, ["a"])) == 0.0


@pytest.mark.parametrize(("given", "plain", "library"), [("s-ch", 10, 18), ("l'ura", 14, 22), ("", 0, 0)])
def test_char_grams(spark, given, plain, library):
    assert len(one(spark, given, lambda c: grams.char_grams(c, 1, 4))) == plain
    assert len(one(spark, given, lambda c: grams.char_grams_wb(c, 1, 4))) == library


def test_word_grams(spark):
    assert one(spark, "Aa b bb cc", lambda c: grams.word_grams(c, 1, 2)) == ["aa", "bb", "cc", "aa bb", "bb cc"]


def test_delta_and_excerpt(spark):
    df = spark.createDataFrame([(0.5, 0.5004), (0.5, 0.6), (0.5, 0.4)], "a double, b double")
    assert [r[0] for r in df.select(text.delta(F.col("a"), F.col("b"))).collect()] == ["≈", "+0.100", "-0.100"]
    assert one(spark, "x" * 100 + "term" + "y" * 100, lambda c: text.excerpt(c, "term", 3)) == "…xxxtermyyy…"


def test_character(spark):
    assert one(spark, "ä", text.character).asDict() == {"category": "Ll", "name": "LATIN SMALL LETTER A WITH DIAERESIS"}


def test_references_without_a_semicolon(spark):
    """A page that is cut inside a reference keeps what is left of it; SQL decodes closed references only."""
    t = "a&amp;b x&amp</p> y&am &copy; &quot;z&quot; &#65; &#x42; &unknown; &notit; &amp"
    assert one(spark, t, lambda c: text.normalize(c, closed=True)) == 'a&b x&amp y&am © "z" A B &unknown; &notit; &amp'
    assert one(spark, t, text.normalize) == 'a&b x& y&am © "z" A B &unknown; ¬it; &'


@pytest.mark.parametrize("closed", [False, True])
def test_plain_texts_stay_in_the_jvm(spark, closed):
    """What the JVM does with a text of ASCII characters without & is what Python does, and Python sees the others only."""
    texts = [None, "", "a<b>c", "<>", "a < b", "<a\nb>\x1fc\x00d", "<<a>>b>", "x>y<z", "ä<b>ﬁ", "&lt;b&gt; <c>", "&amp", "&#x41;", "soft\xadly "]
    f = text.decompose_closed if closed else text.decompose
    got = [r.r for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(f("t").alias("r")).collect()]
    assert got == [text._decompose(t, closed) for t in texts]
    assert text.decompose_arrow.returnType.simpleString() == "string" and len(text._decomposed(pa.array(texts * 20), closed)) == 20 * len(texts)

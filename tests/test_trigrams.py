"""Trigrams counted in place against the same counts as rows."""

from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from florilege.functions import grams
from florilege.operators import detectors, trigrams
from florilege.plans import catalog

TEXTS = ["Lala lala, 12 lala!", "", None, "  ", "a", "ab", "\U0001f600\U0001f600 öÖ ß İx", "bobo " * 50, "x\ty\nz" * 9]


def _docs(spark):
    return spark.createDataFrame([(i, t, ("x", "y", None)[i % 3]) for i, t in enumerate(TEXTS * 2)], "id long, text string, lang string")


def test_totals(spark):
    df = _docs(spark)
    want = Counter((r.lang, r.t) for r in df.select("lang", F.explode(grams.trigrams("text")).alias("t")).collect())
    assert {(r.lang, r.trigram): r.n for r in trigrams.totals(df, "lang").collect()} == want


def test_pieces(monkeypatch):
    """A long text is cut in pieces, and no trigram is lost or counted twice between them."""
    texts = pa.array(["abcdefghij" * 3, None, "xy", "", "klmno" * 7, "pqr"])
    want = Counter((i, t[k : k + 3]) for i, t in enumerate(texts.to_pylist()) if t for k in range(len(t) - 2))
    for size in (1, 2, 3, 7, 1000):
        monkeypatch.setattr(trigrams, "CHARS", size)
        got = Counter((r, trigrams.string(k)) for row, key in trigrams.cut(texts) for r, k in zip(row.tolist(), key.tolist(), strict=True))
        assert got == want


def test_distances_without_a_row_per_trigram(spark):
    """The same distances as by rows; ids that are null or repeated are one text; no trigram of a text is exploded."""
    df = _docs(spark).withColumn("text", F.concat(F.lit("lala "), "text", F.lit(" bobo bobo"))).withColumn("may", F.when(F.col("id") % 2 == 0, F.array(F.lit("x"))))
    profile = detectors.trigram_profile(df.where("lang IS NOT NULL"), "lang", top=20)
    langs = profile.select("lang", "ord").distinct()
    for may in (None, "may"):
        own = [] if may is None else [F.col("may").alias("_may")]
        read = df.where(detectors.readable("text", longest=2048)).select("id", "text", *own)
        want = {tuple(r) for r in detectors._distances_by_id(read, profile, langs).collect()}
        got = detectors.trigram_distances(df, "id", profile, candidates=may)
        assert want and sorted(map(tuple, got.collect())) == sorted(want)
        assert "explode(transform" not in str(got._jdf.queryExecution().optimizedPlan()) and "Generate explode(element_at" not in got._jdf.queryExecution().executedPlan().toString()
    odd = df.where("id < 3").select("text").unionByName(df.where("id > 6").select("text")).withColumn("id", F.lit(None).cast("long")).unionByName(df.where("id = 7").select("text", "id"))
    one = {(r.id, r.lang): r.distance for r in detectors.trigram_distances(odd, "id", profile).collect()}
    joined = odd.where("id IS NULL").agg(F.flatten(F.collect_list(grams.trigrams("text"))).alias("t")).first()["t"]
    ranks = {(r.lang, r.trigram): r["rank"] for r in profile.collect()}
    assert len(one) == 4 and all(one[None, lang] == sum(abs(n - ranks[lang, t] - 1) if (lang, t) in ranks else 300 for t, n in Counter(joined).items()) for lang in "xy")


def test_text_in_pieces(spark):
    """Counts of a text that is cut in pieces meet."""
    n = trigrams.CHARS // 4
    df = spark.createDataFrame([(1, "lala " * 3), (2, "lalabobo " * n), (3, "bobo lala la")], "id long, text string")
    profile = detectors.trigram_profile(df, "id", top=5)
    got = {(r.id, r.lang): r.distance for r in detectors.trigram_distances(df, "id", profile, longest=None).collect()}
    ranks = {(r.lang, r.trigram): r["rank"] for r in profile.collect()}
    for i, t in ((1, " lala lala lala "), (2, " " + "lalabobo " * n), (3, " bobo lala la ")):
        counts = Counter(t[k : k + 3] for k in range(len(t) - 2))
        assert all(got[i, lang] == sum(abs(c - ranks[lang, x] - 1) if (lang, x) in ranks else 300 for x, c in counts.items()) for lang in (1, 2, 3))


#: characters of two units before the cut and across it, kana, no ASCII letter, other white space, small letters that are two or depend on their place
ODD = ["😀 hello world " * 200, "hello " * 339 + "abc😀😀 x", "ひらがな カタカナ abc", "é è à ü éé öü", "ＨＥＬＬＯ", "hello\x0bworld \x0b\x0b this", "\t\x0c hello\r\nthe\x1c x\u0085y\u00a0z\n", "İstanbul hello İİ", "ΣΑΣ hello ΣΑΣ ΟΔΟΣ.ΑΣ", "я" * 2038 + " hello", "", None, "a"]


@pytest.mark.parametrize("name", ["trigram_distance_cut", "trigram_profile"])
def test_odd_texts_as_in_sql(spark, tmp_path, name):
    rows = [(i, t, ("en", "fr", None)[i % 3]) for i, t in enumerate(ODD)] + [(0, "hello the world again", "fr"), (None, "world of odd rows", "en"), (None, "more of them", "de")]
    spark.createDataFrame([(*r, "s1") for r in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("b1", "hello the world of benchmarks")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for x in ("documents", "benchmark"):
        con.sql(f"create view {x} as select * from '{tmp_path}/{x}.parquet/*.parquet'")
    want = con.sql(catalog.ORACLE[name])
    got = catalog.QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert got and Counter(map(tuple, got)) == Counter(want.fetchall())

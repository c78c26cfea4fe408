"""Relational operators on small fixtures, and invariance under partitioning."""

import json

import pytest
from pyspark.sql import functions as F

from florilege.operators import dedup, detectors, foreign, linear, metrics, quality, splits
from florilege.operators.features import spaces, term_counts, tfidf, vocabulary


def corpus(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, source string, label string, text string")


def seqs(df):
    return sorted(r.seq for r in df.select("seq").collect())


def test_within_source_keeps_first(spark):
    df = corpus(spark, [("a", "x", "t"), ("a", "x", "t"), ("b", "x", "t"), ("a", "y", "t")])
    assert seqs(dedup.within_source(df)) == [0, 2, 3]
    assert seqs(dedup.within_source(dedup.within_source(df).repartition(7))) == [0, 2, 3]


def test_across_sources(spark):
    df = corpus(spark, [("p0", "x", "one"), ("p1", "x", "one"), ("p0", "x", "two"), ("p1", "y", "two"), ("p0", "x", "three"), ("p0", "y", "three"), ("p1", "x", "four"), ("p1", "x", "four")])
    order = F.substring("source", 2, 1).cast("int")
    assert seqs(dedup.across_sources(df, order)) == [0, 6, 7]
    assert dedup.dedup_counts(df, order).first().asDict() == {"contradictory": 2, "redundant": 1, "removed": 5}


def test_foreign_filter(spark):
    df = corpus(spark, [("s", "rm-sursilv", "Val Müstair bella."), ("s", "rm-sursilv", "Jörg vegn. El è zürich. Fin."), ("s", "rm-sursilv", "zürich."), ("s", "xx", "zürich."), ("s", "rm-puter", "ögl bun.")])
    got = {r.seq: (r.text, r.changed) for r in foreign.foreign_filter(df).collect()}
    assert got == {0: ("Val Müstair bella.", False), 1: ("$NE$ vegn. Fin.", True), 3: ("zürich.", False), 4: ("ögl bun.", False)}
    assert [tuple(r) for r in foreign.foreign_triggers(df).collect()] == [("zürich.", 2)] or [tuple(r) for r in foreign.foreign_triggers(df).collect()] == [("zürich", 1), ("zürich.", 1)]


@pytest.mark.parametrize(("n", "test"), [(5575, 1115), (345, 69), (1594, 318), (1, 1)])
def test_ratio_sizes(spark, n, test):
    df = spark.range(n).select(F.col("id").alias("seq"), F.lit("x").alias("label"))
    got = splits.by_ratio(df, "seq")
    assert got.where("split = 'test'").count() == test and got.count() == n
    assert seqs(got.where("split = 'test'")) == seqs(splits.by_ratio(df.repartition(5), "seq").where("split = 'test'"))


@pytest.mark.parametrize(("n", "sizes"), [(399, {"train": 399}), (400, {"dev": 200, "test": 200}), (500, {"dev": 200, "test": 200, "train": 100})])
def test_balanced(spark, n, sizes):
    df = spark.range(n).select(F.col("id").alias("seq"), F.lit("x").alias("label"))
    assert {r.split: r["count"] for r in splits.balanced(df, "seq").groupBy("split").count().collect()} == sizes


def test_folds_are_even(spark):
    df = spark.range(103).select(F.col("id").alias("seq"), F.lit("x").alias("label"))
    assert sorted(r["count"] for r in splits.folds(df, "seq").groupBy("fold").count().collect()) == [20, 20, 21, 21, 21]


def test_index_quantiles(spark):
    df = spark.createDataFrame([("x", "a" * n) for n in (1, 2, 3, 4)], "label string, text string")
    r = quality.length_stats(df, ["label"]).first()
    assert (r.n, r.min, r.median, r.p75, r.p90, r.max) == (4, 1, 2, 4, 4, 4)  # 2.5 rounds half to even
    b = quality.box_stats(df, ["label"]).first()
    assert (b.q1, b.median, b.q3, b.outliers) == (2, 2.5, 4, 0)


def test_metrics(spark):
    df = spark.createDataFrame([("s", "a", "a"), ("s", "a", "z"), ("s", "b", "a"), ("s", "b", "b")], "set string, y string, p string")
    got = {r["class"]: (r.precision, r.recall, round(r.f1, 4), r.support) for r in metrics.per_class(df, ["set"]).collect()}
    assert got == {"a": (0.5, 0.5, 0.5, 2), "b": (1.0, 0.5, 0.6667, 2)}
    assert round(metrics.macro(df, ["set"]).first().macro_f1, 4) == 0.5833
    cells = {(r.y, r.p): (r.n, r.share) for r in metrics.confusion(df, ["set"]).collect()}
    assert cells == {("a", "a"): (1, 1.0), ("a", "b"): (0, 0.0), ("b", "a"): (1, 0.5), ("b", "b"): (1, 0.5)}
    doc = json.loads(metrics.result_document(df, "m", "here", "now", {"s": "Set S"}).toJSON().first())
    assert doc["name"] == "m" and doc["timestamp"] == "now" and doc["test_sets"]["s"]["label"] == "Set S"
    assert doc["test_sets"]["s"]["accuracy"] == 0.5 and doc["test_sets"]["s"]["per_class"]["b"]["support"] == 2


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame([(1, "aa bb aa"), (2, "cc dd")], "id long, text string")
    counts = term_counts(df, "id", spaces("text", None, (1, 1)))
    vocab = vocabulary(counts, 2)
    feats = tfidf(counts, vocab)
    coef, heads = linear.class_means(feats, spark.createDataFrame([(1, "x"), (2, "y")], "id long, class string"))
    return linear.LinearModel(vocab, coef, heads, None, (1, 1))


def test_linear_model(spark, model):
    df = spark.createDataFrame([(1, "aa bb"), (2, "dd"), (3, "zz"), (4, None)], "id long, text string")
    scores = linear.score(model, df, "id")
    assert scores.count() == 8  # every class, also without known terms
    assert {r.id: r["class"] for r in linear.predict(scores).collect()} == {1: "x", 2: "y", 3: "x", 4: "x"}  # the first class wins ties
    assert all(abs(r.s - 1) < 1e-9 for r in linear.soft_scores(scores).groupBy("id").agg(F.sum("share").alias("s")).collect())
    again = linear.score(linear.load(spark, linear.export(model)), df, "id")
    assert sorted((r.id, r["class"], round(r.score, 9)) for r in again.collect()) == sorted((r.id, r["class"], round(r.score, 9)) for r in scores.collect())
    with pytest.raises(TypeError):
        linear.load(spark, 3)


def test_unit_norm(spark):
    df = spark.createDataFrame([(1, "aa bb aa cc"), (2, "")], "id long, text string")
    counts = term_counts(df, "id", spaces("text", (1, 2), (1, 1)))
    w = tfidf(counts, vocabulary(counts, 2)).groupBy("id", "space").agg(F.sum(F.col("w") * F.col("w")).alias("n"))
    assert {r.space: round(r.n, 9) for r in w.collect()} == {"char": 1.0, "word": 1.0}


def test_trigram_detector(spark):
    df = spark.createDataFrame([("x", "lala lala lala lala"), ("y", "bobo bobo bobo bobo")], "lang string, text string")
    profile = detectors.trigram_profile(df, "lang")
    docs = spark.createDataFrame([(1, "lala lala la"), (2, "bobo bobo"), (3, "bobobo bobo"), (4, "ぁぁぁぁぁぁぁぁぁぁぁ"), (5, None)], "id long, text string")
    assert {r.id: r.lang for r in detectors.trigram_label(docs, "id", profile).collect()} == {1: "x", 2: "und", 3: "y", 4: "und", 5: "und"}


def test_coverage(spark):
    words = spark.createDataFrame([("x", "aa"), ("y", "aa"), ("x", "bb"), ("y", "cc")], "lang string, word string")
    docs = spark.createDataFrame([(1, "aa bb"), (2, "zz zz"), (3, "aa"), (4, None)], "id long, text string")
    scores = detectors.coverage(docs, "id", words)
    got = {(r.id, r.lang): round(r.score, 4) for r in scores.collect()}
    assert got[(1, "x")] == 1.0 and got[(1, "y")] == 0.3333 and got[(2, "x")] == 0.0 and got[(3, "x")] == got[(3, "y")] == 1.0
    assert {r.id: r.lang for r in detectors.coverage_label(scores).collect()} == {1: "x", 2: "und", 3: "x", 4: "und"}


def test_registry(spark):
    docs = spark.createDataFrame([(1, "ü ö s-ch")], "id long, text string")
    assert detectors.REGISTRY["markers"](docs).first().lang == "rm-vallader"


def test_model_as_detector(spark, model):
    detectors.register("means", linear.as_detector(model))
    assert detectors.REGISTRY.pop("means")(spark.createDataFrame([(1, "dd cc")], "id long, text string")).first().lang == "y"


def test_stages_are_released(spark):
    from florilege import session

    df = session.stage(spark.range(5).toDF("x"), "t")
    assert df.count() == 5
    session.release(spark)
    with pytest.raises(Exception):  # noqa: B017
        df.count()


def test_streamed_labels_normalise_once(spark):
    from florilege.functions import text
    from florilege.streaming import score

    df = spark.createDataFrame([("über die Bäche",), ("s-ch <b>&uuml;</b>",), ("la chasa è qua",), (None,), ("",)], "text string")
    got = score.labelled(df)
    want = df.withColumn("n", text.normalize("text")).withColumn("lang", detectors.marker_label("n"))
    assert [r.lang for r in got.collect()] == [r.lang for r in want.collect()]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 4


def test_foreign_filter_masks_once(spark):
    """Every name is replaced in a text once, not in each condition on the masked text."""
    df = spark.createDataFrame([("rm-puter", "Müller va. Il Bär ä. Fin."), ("rm-puter", "Jäger va."), ("rm-sursilv", None), ("rm-sursilv", "Ün. Dus.")], "label string, text string")
    got = foreign.foreign_filter(df)
    assert [tuple(r) for r in got.collect()] == [("rm-puter", "$NE$ va. Fin.", True), ("rm-puter", "Jäger va.", False), ("rm-sursilv", None, False), ("rm-sursilv", "Dus.", True)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Müstair, $NE$") == 2  # Val Müstair and Müstair

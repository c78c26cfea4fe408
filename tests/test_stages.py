"""Spark ML stages: fitted, saved, loaded in another session, with the same labels."""

import os
import subprocess
import sys

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from florilege.operators import linear
from florilege.operators.stages import TextClassifier, TextClassifierModel, TextCleaner
from florilege.plans import train

ROWS = [("a", "Ban tor lin"), ("a", "ban banon torez"), ("b", "mur sel murut"), ("b", "Selez mura 12"), ("c", "pik pikon piker"), ("c", "pikut piker"), ("c", "pikut piker"), ("a", "tor linon"), (None, "no label"), ("b", None)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "label string, text string").withColumn("_text_key", F.lit("clash"))


def labels(df):
    return sorted((r.text or "", r.prediction) for r in df.select("text", "prediction").collect())


@pytest.mark.parametrize("kind", ["means", "svm", "logistic"])
def test_saved_and_loaded(spark, rows, tmp_path, kind):
    pipeline = Pipeline(stages=[TextCleaner(inputCol="text", outputCol="clean"), TextClassifier(inputCol="clean", kind=kind, C=2.0, char=(1, 3), limits=(500, 100), iterations=40)])
    pipeline.write().overwrite().save(f"{tmp_path}/unfitted")
    model = Pipeline.load(f"{tmp_path}/unfitted").fit(rows)
    said = labels(model.transform(rows))
    assert len(said) == len(ROWS) and {"_text_key", "clean", "prediction"} <= set(model.transform(rows).columns)
    assert sum(p == y for y, t in ROWS for u, p in said if t == u) >= 8
    model.write().overwrite().save(f"{tmp_path}/fitted")
    model.write().overwrite().save(f"{tmp_path}/fitted")
    loaded = PipelineModel.load(f"{tmp_path}/fitted")
    assert isinstance(loaded.stages[1], TextClassifierModel) and labels(loaded.transform(rows)) == said
    with pytest.raises(Exception, match="already exists"):
        model.save(f"{tmp_path}/fitted")


def test_another_session(spark, rows, tmp_path):
    model = Pipeline(stages=[TextCleaner(), TextClassifier(inputCol="clean", kind="means", char=(1, 2))]).fit(rows)
    model.save(f"{tmp_path}/m")
    rows.write.parquet(f"{tmp_path}/rows")
    code = (
        "import sys; from pyspark.ml import PipelineModel; from florilege.session import local_session\n"
        "s = local_session('other', 2, 2, '1g'); m = PipelineModel.load(sys.argv[1]); m.transform(s.read.parquet(sys.argv[2])).write.parquet(sys.argv[3])"
    )
    subprocess.run([sys.executable, "-c", code, f"{tmp_path}/m", f"{tmp_path}/rows", f"{tmp_path}/out"], check=True, timeout=240, env=os.environ, cwd=os.path.dirname(os.path.dirname(__file__)))
    assert labels(spark.read.parquet(f"{tmp_path}/out")) == labels(model.transform(rows))


def test_model_of_json_in_a_pipeline(spark, rows):
    """Any linear model can be a stage, also one that was exported."""
    p = {"C": 1.0, "char": (1, 2), "word": (1, 1), "max_char": 100, "max_word": 50, "min_char": 1, "min_word": 1}
    some = spark.createDataFrame([(i, y, t) for i, (y, t) in enumerate(ROWS) if y and t], "id long, class string, text string")
    model = train.fitted(some, p, "svm")
    stage = TextClassifierModel(linear.load(spark, linear.export(model)))
    stage._set(inputCol="text", predictionCol="said")
    want = {r.id: r["class"] for r in linear.predict(linear.score(model, some, "id")).collect()}
    assert {r.id: r.said for r in stage.transform(some).collect()} == want


def test_no_such_kind(rows):
    with pytest.raises(ValueError):
        TextClassifier(kind="forest").fit(rows)

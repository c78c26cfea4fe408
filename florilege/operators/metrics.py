"""Evaluation of predictions ``(set, y, p)`` and comparison of models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def accuracy(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_samples"), F.avg((F.col("y") == F.col("p")).cast("double")).alias("accuracy"))


def per_class(df: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall, F1 and support of the classes that occur as true labels; 0 on division by zero. A
    prediction of another class only costs recall."""
    cells = df.groupBy(*by, "y", "p").agg(F.count(F.lit(1)).alias("n"))
    true = cells.groupBy(*by, F.col("y").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    said = cells.groupBy(*by, F.col("p").alias("class")).agg(F.sum("n").alias("said"))
    both = true.join(said, [*by, "class"], "left")
    precision = F.when(F.coalesce("said", F.lit(0)) > 0, F.col("tp") / F.col("said")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    out = both.withColumns({"precision": precision, "recall": recall})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.withColumn("f1", f1).select(*by, "class", "precision", "recall", "f1", "support")


def macro(df: DataFrame, by: list[str]) -> DataFrame:
    """Means over the classes."""
    return per_class(df, by).groupBy(*by).agg(*(F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")))


def confusion(df: DataFrame, by: list[str], classes: DataFrame | None = None) -> DataFrame:
    """Counts of each (true, predicted) pair of classes, zeros included, and each row's shares."""
    known = classes if classes is not None else df.select(*by, F.col("y").alias("class")).distinct()
    rows = known.select(*by, F.col("class").alias("y"))
    grid = rows.join(known.select(*by, F.col("class").alias("p")), by) if by else rows.crossJoin(known.select(F.col("class").alias("p")))  # classes by classes
    cells = df.groupBy(*by, "y", "p").agg(F.count(F.lit(1)).alias("n"))
    out = grid.join(cells, [*by, "y", "p"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    total = F.sum("n").over(W.partitionBy(*by, "y"))
    return out.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def class_distribution(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by, "y").agg(F.count(F.lit(1)).alias("n"))


def ordered_classes(df: DataFrame, by: list[str], canonical: list[str]) -> DataFrame:
    """``class, place``: the true classes of each set in canonical order; classes outside it take no part."""
    names = F.array(*(F.lit(c) for c in canonical))
    return df.select(*by, F.col("y").alias("class")).distinct().withColumn("place", F.array_position(names, F.col("class")).cast("int")).where("place > 0")


def classes_seen(results: list[DataFrame], column: str = "y") -> DataFrame:
    """The classes that any of several results hold, in order."""
    return reduce(DataFrame.union, (r.select(F.col(column).alias("class")) for r in results)).distinct().orderBy("class")


def best_worst(results: DataFrame) -> DataFrame:
    """``results(model, set, metric, value)`` with ``best`` and ``worst`` marked where a set's values differ."""
    cell = W.partitionBy("set", "metric")
    r = results.withColumns({"_hi": F.max("value").over(cell), "_lo": F.min("value").over(cell)})
    spread = F.col("_hi") > F.col("_lo")
    return r.withColumns({"best": spread & (F.col("value") == F.col("_hi")), "worst": spread & (F.col("value") == F.col("_lo"))}).drop("_hi", "_lo")


def compare(a: DataFrame, b: DataFrame, threshold: float = 0.001) -> DataFrame:
    """Two result tables (set, metric, value) side by side, missing cells as null, with the difference."""
    both = a.select("set", "metric", F.col("value").alias("a")).join(b.select("set", "metric", F.col("value").alias("b")), ["set", "metric"], "full_outer")
    return both.withColumns({"delta": F.col("b") - F.col("a"), "alike": F.abs(F.col("b") - F.col("a")) < threshold})


def result_document(df: DataFrame, name: str, source: str, timestamp: str, labels: dict[str, str] | None = None) -> DataFrame:
    """One row ``name, source, timestamp, test_sets``: per test set its label, number of samples, accuracy, macro F1 and per-class figures, to six
    decimals. The type is the one that ``readers.result_documents`` reads; ``labels`` gives sets a longer name."""
    def six(c: str) -> Column:
        return F.round(c, 6).alias(c)

    figures = F.struct(six("f1"), six("precision"), six("recall"), "support")
    classes = per_class(df, ["set"]).groupBy("set").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("class", figures)))).alias("per_class"))
    sets = accuracy(df, ["set"]).join(macro(df, ["set"]), "set").join(classes, "set")
    title = F.coalesce(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))[F.col("set")], F.col("set")) if labels else F.col("set")
    cell = F.struct(title.alias("label"), "n_samples", six("accuracy"), six("macro_f1"), "per_class")
    whole = sets.agg(F.map_from_entries(F.collect_list(F.struct("set", cell))).alias("test_sets"))  # a row per test set
    return whole.select(F.lit(name).alias("name"), F.lit(source).alias("source"), F.lit(timestamp).alias("timestamp"), "test_sets")

"""Writers. All write through Spark; the few that make one small document return it as text, too."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from florilege.functions.text import clean_for_training
from florilege.operators.dedup import within_source


def write_corpus(df: DataFrame, path: str, seq: str = "seq") -> None:
    """Deduplicated within (source, label), partitioned by both."""
    within_source(df, seq).write.mode("overwrite").partitionBy("source", "label").parquet(path)


def split_lines(df: DataFrame, clean: bool = False) -> DataFrame:
    """``label<tab>text`` lines; with ``clean``, texts cleaned for training and empty ones left out."""
    text = clean_for_training("text") if clean else F.col("text")
    return df.select("label", text.alias("text")).where("text <> ''").select(F.concat_ws("\t", "label", "text").alias("value"))


def write_split(df: DataFrame, path: str, clean: bool = False) -> int:
    """Write a split as text; how many rows were left out as empty. The write itself counts them: its input is read once."""
    return write_split_counted(df, path, clean)["skipped"]


def write_split_counted(df: DataFrame, path: str, clean: bool = False) -> dict[str, int]:
    """Write a split as text; ``samples`` and ``skipped`` of the rows that the write saw."""
    text = clean_for_training("text") if clean else F.col("text")
    seen = Observation(f"split-{uuid.uuid4().hex}")
    watched = df.select("label", text.alias("text")).observe(seen, F.count(F.lit(1)).alias("samples"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("skipped"))
    watched.where("text <> ''").select(F.concat_ws("\t", "label", "text").alias("value")).write.mode("overwrite").text(path)
    return dict(seen.get)


def write_result(document: DataFrame, path: str) -> None:
    """An evaluation (``metrics.result_document``) or corpus statistics (``quality.stats_document``) as one JSON object."""
    document.coalesce(1).write.mode("overwrite").json(path)


def digests(df: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` and two sums of row hashes for each group: equal for equal rows in any order, different (but for chance) for others."""
    row = [F.col(f"`{c}`") for c in sorted(df.columns)]
    sums = [F.sum(F.xxhash64(F.lit(salt), *row).cast("decimal(38,0)")).alias(f"d{salt}") for salt in (0, 1)]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *sums)


def rewrite_changed(df: DataFrame, path: str, by: list[str]) -> list[tuple]:
    """Bring a partitioned Parquet folder to the state of ``df``, writing only partitions whose rows differ: others keep their files.
    Partitions that ``df`` doesn't have stay. Returns the values of those written, as few as the folder has partitions.

    Write ``df`` somewhere first (``session.stage``) if it reads the folder that is rewritten."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        df.write.partitionBy(*by).parquet(path)
        return sorted((tuple(r) for r in df.select(*by).distinct().collect()), key=str)
    old = spark.read.schema(df.schema).parquet(path)
    new = digests(df, by)
    on = reduce(lambda a, c: a & c, (new[c].eqNullSafe(F.col(f"old.{c}")) for c in [*by, "rows", "d0", "d1"]))
    changed = new.join(digests(old, by).alias("old"), on, "left_anti").select(*by)
    values = sorted((tuple(r) for r in changed.collect()), key=str)
    if values:
        wanted = F.broadcast(spark.createDataFrame(values, changed.schema))
        same = reduce(lambda a, c: a & c, (df[c].eqNullSafe(wanted[c]) for c in by))
        df.join(wanted, same, "left_semi").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return values


class RunLog:
    """Counters of a run. ``watch`` hangs counts on a DataFrame, which the action that computes it fills in; ``rows`` gives what was counted."""

    def __init__(self, run: str):
        self.run = run
        self._steps: list[tuple[str, Observation]] = []

    def watch(self, df: DataFrame, step: str, **counts: Column) -> DataFrame:
        """``df``, with ``rows`` and the named counts taken as it streams by."""
        seen = Observation(f"{self.run}-{step}-{uuid.uuid4().hex}")
        self._steps.append((step, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(name) for name, c in counts.items()))

    def rows(self, spark: SparkSession) -> DataFrame:
        """``run, step, place, counter, value``. Waits for the watched DataFrames to be computed."""
        found = [(self.run, step, i, name, int(value or 0)) for i, (step, seen) in enumerate(self._steps) for name, value in seen.get.items()]
        return spark.createDataFrame(found, "run string, step string, place int, counter string, value long")

    def write(self, spark: SparkSession, path: str) -> None:
        """The counters as JSON lines, beside those of earlier runs."""
        self.rows(spark).coalesce(1).write.mode("append").json(path)


def write_json(spark: SparkSession, value: object, path: str) -> str:
    """One small JSON document."""
    text = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text


def write_splits_meta(spark: SparkSession, languages: list[str], path: str) -> str:
    return write_json(spark, {"multilingual": bool(languages), "languages": languages}, path)


def write_triggers(df: DataFrame, path: str) -> None:
    """``count<tab>word``, most frequent first."""
    df.orderBy(F.desc("count"), "word").select(F.concat_ws("\t", F.col("count").cast("string"), "word").alias("value")).write.mode("overwrite").text(path)


def write_params(spark: SparkSession, params: dict, path: str) -> str:
    return write_json(spark, {k: list(v) if isinstance(v, tuple) else v for k, v in params.items()}, path)

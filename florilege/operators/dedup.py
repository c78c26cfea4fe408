"""Duplicate texts within and across sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: sources from the highest priority to the lowest
PRIORITY = ("proprietary-data", "fmr", "rtr-transcripts", "textbooks", "theater-plays", "canton-laws", "pledari-grond")


def priority_of(source: Column, order: tuple[str, ...] = PRIORITY) -> Column:
    """Place in the priority list; unknown sources have none."""
    return F.array_position(F.array(*(F.lit(x) for x in order)), source).cast("int")


def within_source(df: DataFrame, seq: str = "seq") -> DataFrame:
    """The first row of each (source, label, text). The choice is a map-side minimum over short keys, so a text that makes up a
    third of all rows is one row per task; texts are neither sorted nor shuffled by it unless the join needs them to."""
    keyed = df.withColumn("_k", F.md5("text"))
    first = keyed.groupBy(F.col("source").alias("_s"), F.col("label").alias("_l"), F.col("_k").alias("_f")).agg(F.min(seq).alias("_seq"))
    on = keyed["source"].eqNullSafe(first["_s"]) & keyed["label"].eqNullSafe(first["_l"]) & keyed["_k"].eqNullSafe(first["_f"]) & keyed[seq].eqNullSafe(first["_seq"])
    return keyed.join(first, on, "left_semi").drop("_k")


def text_marks(df: DataFrame, priority: Column) -> DataFrame:
    """Per text (by md5): ``contradictory`` (more than one label), ``best`` (highest priority) and ``places`` (distinct sources)."""
    return df.groupBy(F.md5("text").alias("_k")).agg(
        (F.min("label") != F.max("label")).alias("contradictory"), F.min(priority).alias("best"), F.countDistinct("source", "label").alias("places"), F.count(F.lit(1)).alias("rows"))


def across_sources(df: DataFrame, priority: Column) -> DataFrame:
    """Texts with contradictory labels go everywhere; of the others the source of highest priority (the smallest
    number) keeps its rows. Two rows of one text in one source and label both stay."""
    marks = text_marks(df, priority).where("NOT contradictory").select("_k", "best")
    return df.withColumns({"_k": F.md5("text"), "_p": priority}).join(marks, "_k").where("_p = best").drop("_k", "_p", "best")


def removed(df: DataFrame, priority: Column) -> DataFrame:
    """The rows that ``across_sources`` takes away, with ``contradictory``: whether for their text's labels or for its source."""
    marks = text_marks(df, priority).select("_k", "contradictory", "best")
    return df.withColumns({"_k": F.md5("text"), "_p": priority}).join(marks, "_k").where(F.col("contradictory") | (F.col("_p") > F.col("best"))).drop("_k", "_p", "best")


def dedup_counts(df: DataFrame, priority: Column) -> DataFrame:
    """One row: contradictory texts, redundant texts, rows removed."""
    marks = text_marks(df, priority)
    rows = df.withColumns({"_k": F.md5("text"), "_p": priority}).join(marks, "_k")
    gone = rows.agg(F.coalesce(F.sum((F.col("contradictory") | (F.col("_p") > F.col("best"))).cast("long")), F.lit(0)).alias("removed"))
    kinds = marks.agg(F.coalesce(F.sum(F.col("contradictory").cast("long")), F.lit(0)).alias("contradictory"), F.coalesce(F.sum((~F.col("contradictory") & (F.col("places") > 1)).cast("long")), F.lit(0)).alias("redundant"))
    return kinds.crossJoin(gone)  # one row by one row


def duplicate_report(df: DataFrame, least: int = 40, top: int | None = 50, without: tuple[str, ...] = ("pledari-grond",)) -> DataFrame:
    """Texts of ``least`` characters or more in more than one (source, label): the report's first ``top``. Sources
    ``without`` (the dictionary) take no part."""
    found = (
        df.where((F.length("text") >= least) & ~F.col("source").isin(*without)).groupBy(F.md5("text").alias("text_md5"))
        .agg(F.min("text").alias("text"), F.countDistinct("source", "label").alias("places"), F.count(F.lit(1)).alias("rows")).where("places > 1")
    )
    return found.orderBy(F.desc("rows"), "text_md5").limit(top) if top else found

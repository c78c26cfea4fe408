"""The corpus build as one lineage: union of sources, dedup within, sentence filter, dedup across, splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.operators import dedup, foreign, splits
from florilege.session import stage


def numbered(df: DataFrame) -> DataFrame:
    """A ``seq`` that follows the order in which Spark reads; ids are unique, not dense."""
    return df.withColumn("seq", F.monotonically_increasing_id())


def build(parts: list[DataFrame], rules: dict[str, str] | None = None, allowed: tuple[str, ...] = foreign.ALLOWED, priority: Column | None = None) -> DataFrame:
    """Cleaned corpus ``source, label, text, seq``. Sentences are filtered after dedup within sources and before dedup
    across them; encyclopedia rows take no part in the latter."""
    df = stage(numbered(reduce(DataFrame.unionByName, parts)), "numbered")  # the numbers stay what they are
    df = dedup.within_source(df)
    df = foreign.foreign_filter(df, rules or foreign.FOREIGN, allowed).drop("changed")
    order = priority if priority is not None else dedup.priority_of(F.col("source"))
    aside = df.where(F.col("source") == "wikipedia")
    kept = dedup.across_sources(df.where(F.col("source") != "wikipedia"), order)
    return stage(kept.unionByName(aside), "corpus")


def split(df: DataFrame, key: str = "seq") -> DataFrame:
    """``split`` by source: a fifth of the news to test_a and of the textbooks to test_c, balanced dev and test_b from the
    transcripts, proprietary rows are test_d, encyclopedia rows go three ways (test_e), all else is training text."""
    n, r = F.col("total"), F.col("rank")
    fifth, tenth = F.greatest(F.lit(1), F.floor(n * 0.2)), F.floor(n * 0.1)
    plan = {
        "fmr": F.when(r <= fifth, "test_a").otherwise("train"),
        "rtr-transcripts": F.when((n >= 400) & (r <= 200), "dev").when((n >= 400) & (r <= 400), "test_b").otherwise("train"),
        "textbooks": F.when(r <= fifth, "test_c").otherwise("train"),
        "proprietary-data": F.lit("test_d"),
        "wikipedia": F.when(r <= tenth, "test_e").when(r <= 2 * tenth, "dev").otherwise("train"),
    }
    return splits.allocate(df, key, plan)


def test_sets(multilingual: bool) -> list[str]:
    """Names of the test splits; the encyclopedia's belongs to the multilingual mode."""
    return [f"test_{x}" for x in ("abcde" if multilingual else "abcd")]

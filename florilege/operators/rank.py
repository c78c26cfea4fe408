"""Ranking inside groups of any size, and quantiles from counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _placed(df: DataFrame, groups: list[str], key: Column, seed: str, digits: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_md5`` and ``_part`` (its first digits), and how many rows of the group lie in earlier parts (``_before``) and in all."""
    code = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(key.cast("string"), F.lit(""))))
    dealt = df.withColumn("_md5", code).withColumn("_part", F.substring("_md5", 1, digits))
    sizes = dealt.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"))
    group = W.partitionBy(*groups)
    before = sizes.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_part").alias("_p"), (F.sum("_n").over(group.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(group).alias("total"))
    return dealt, before


def _same(groups: list[str]) -> Column:
    on = F.col("_part") == F.col("_p")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return on


def hash_ranked(df: DataFrame, groups: list[str], key: Column | str, seed: str = "42") -> DataFrame:
    """Adds ``rank`` (from 1, by md5 of ``seed|key`` within the groups; a null key counts as an empty one) and ``total``.

    A window over a whole group would rank it in one task, and a group may hold most rows. So rows are
    ranked within 65536 parts of their group, by the hash's first four digits (150,000 rows each of ten thousand million), and the
    ranks of earlier parts come from their counts: 65536 rows a group at most."""
    key = F.col(key) if isinstance(key, str) else key
    dealt, before = _placed(df, groups, key, seed)
    placed = dealt.join(before, _same(groups))
    rank = F.row_number().over(W.partitionBy(*groups, "_part").orderBy("_md5", key))
    return placed.withColumn("rank", (rank + F.col("_before")).cast("long")).drop("_md5", "_part", "_before", "_p", *[f"_g{i}" for i in range(len(groups))])


def smallest(df: DataFrame, groups: list[str], key: Column | str, k: int, seed: str = "42") -> DataFrame:
    """The k rows of each group whose key has the smallest md5 of ``seed|key``: a sample that neither order nor partitioning changes.

    How many rows lie in each of 65536 parts of a group is counted map-side; only parts that begin before the k-th row
    go on, so what is ranked is k rows and one part's at most, whatever the group holds."""
    key = F.col(key) if isinstance(key, str) else key
    dealt, before = _placed(df, groups, key, seed)
    some = dealt.join(before.where(F.col("_before") < k), _same(groups))
    rank = F.row_number().over(W.partitionBy(*groups).orderBy("_md5", key))
    return some.withColumn("_rank", rank).where(F.col("_rank") <= k).select(*df.columns)


def length_counts(df: DataFrame, groups: list[str], value: Column) -> DataFrame:
    """``value, n, upto`` for each group: how many rows have the value, and at most it. One row per distinct value."""
    counts = df.select(*groups, value.alias("value")).groupBy(*groups, "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("upto", F.sum("n").over(W.partitionBy(*groups).orderBy("value"))).withColumn("total", F.sum("n").over(W.partitionBy(*groups)))


def at_index(index: Column) -> Column:
    """Aggregate over ``length_counts``: the value at a place (from 0) of the sorted column."""
    return F.min(F.when(F.col("upto") > index, F.col("value")))


def quantile_index(q: float) -> Column:
    """The place of an index quantile: int(n * q), the last at most."""
    return F.least(F.floor(F.col("total") * F.lit(q)), F.col("total") - 1)

"""Finding windows that start more than once in a corpus, for the two exact-repeat operators.

Every fixed-length window is dealt to an anchor inside it (see ``core.winnow``). Runs of
windows meet by anchor in one shuffle of a few small rows per document:

* an anchor seen once: none of its windows recur, the run is dropped;
* runs with equal content (``ctx``): all their windows recur;
* the rest, at the rims of repeated passages, are settled window by window by the caller.

Of several equal runs only the first is handed on (``kind`` PROVIDER) to be compared with
runs that stand alone (``kind`` SOLO), so a group of copies of any size adds one row. Equal runs of one
block are merged before the shuffle (``core.collapse``): weight 2 stands for two or more, weight 0
marks spans that are settled already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from florilege.session import stage

SURE, PROVIDER, SOLO = 0, 1, 2
RUN = "lo long, n int, rel int, anchor long, ctx long, w int"


def marked(runs: DataFrame, tag: str) -> DataFrame:
    """Keep runs whose anchor recurs; add ``kind`` and ``nctx`` (distinct contents of the anchor)."""
    by = W.partitionBy("anchor")
    seen = (
        runs.withColumns({"_c": F.sum("w").over(by), "_mn": F.min("ctx").over(by), "_mx": F.max("ctx").over(by)})
        .where("_c > 1 OR w = 0")
    )
    alike = W.partitionBy("anchor", "ctx")
    mixed = F.col("_mn") != F.col("_mx")
    rank = F.row_number().over(alike.orderBy("_id", "_h", "lo"))
    out = seen.withColumns({"_n": F.sum("w").over(alike), "_r": rank}).withColumn(
        "kind",
        F.when(~mixed | (F.col("w") == 0), SURE).when(F.col("_n") == 1, SOLO).when(F.col("_r") == 1, PROVIDER).otherwise(SURE),
    )
    out = out.withColumn("nctx", F.sum(F.when(F.col("_r") == 1, 1).otherwise(0)).over(by))
    return stage(out.select("_id", "_h", "lo", "n", "rel", "anchor", F.col("kind").cast("int").alias("kind"), F.col("nctx").cast("int").alias("nctx")), tag)


def sure_starts(seen: DataFrame) -> DataFrame:
    """Repeated window starts that need no further look: ``_id, _h, a, b`` (b excluded)."""
    return seen.where(F.col("kind") != SOLO).select("_id", "_h", F.col("lo").alias("a"), (F.col("lo") + F.col("n")).alias("b"))


def per_document(rows: DataFrame, fields: list[str], name: str) -> DataFrame:
    """A document's rows as one array (as long as the document at most)."""
    return rows.groupBy("_id", "_h").agg(F.collect_list(F.struct(*fields)).alias(name))


def counted(windows: DataFrame) -> DataFrame:
    """Windows ``_id, _h, at, solo, anchor, rel, code``: the SOLO ones whose (anchor, rel, code) recurs,
    as ``_id, _h, a, b``. Counting is a plain aggregate with map-side sums; the join that follows
    meets a unique side, so a hot window splits as any skewed join."""
    key = ["anchor", "rel", "code"]
    twice = windows.groupBy(*key).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select(*key)
    return windows.where("solo").join(twice, key, "left_semi").select("_id", "_h", F.col("at").alias("a"), (F.col("at") + 1).alias("b"))

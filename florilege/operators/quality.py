"""Corpus statistics and validation reports as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from florilege.functions.text import average, character, tokens
from florilege.operators.rank import at_index, length_counts, quantile_index, smallest
from florilege.session import stage

#: fixed value: a character reference
ENTITY = r"&(?:[a-zA-Z]{2,8}|#[0-9]{1,6}|#x[0-9a-fA-F]{1,6});"
#: fixed values: code points that shouldn't be in a clean text
SUSPICIOUS = {0x00AD: "Soft Hyphen", 0x00A0: "Non-Breaking Space", 0x200B: "Zero-Width Space", 0x200C: "Zero-Width Non-Joiner", 0x200D: "Zero-Width Joiner", 0xFEFF: "BOM / ZWNBSP", 0x2028: "Line Separator", 0x2029: "Paragraph Separator"}


def sample_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """``samples, tokens, average`` of each group."""
    n = df.select(*by, F.size(tokens("text")).cast("long").alias("t")).groupBy(*by).agg(F.count(F.lit(1)).alias("samples"), F.sum("t").alias("tokens"))
    return n.withColumn("average", average(F.col("tokens"), F.col("samples")))


def cube_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of each cell, row, column and of all (null stands for all)."""
    return df.cube(a, b).agg(F.count(F.lit(1)).alias("samples"))


def pivot_counts(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """A row per ``row`` and a column per value, with zeros, and ``total`` over these values."""
    out = df.where(F.col(column).isin(values)).groupBy(row).pivot(column, values).agg(F.count(F.lit(1)))
    cells = [F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("long") for v in values]
    total = cells[0]
    for c in cells[1:]:
        total = total + c
    return out.select(row, *(c.alias(v) for c, v in zip(cells, values, strict=True)), total.alias("total"))


def zero_filled(df: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """``samples, tokens, average`` for every row of the catalogue ``rows``, zeros where the data has none."""
    n = sample_counts(df, by).drop("average")
    filled = rows.join(n, by, "left").withColumns({"samples": F.coalesce("samples", F.lit(0)).cast("long"), "tokens": F.coalesce("tokens", F.lit(0)).cast("long")})
    return filled.withColumn("average", average(F.col("tokens"), F.col("samples")))


def length_stats(df: DataFrame, by: list[str]) -> DataFrame:
    """n, min, median (half-even to whole numbers), p75 and p90 by index, mean, max of text lengths. Quantiles come from
    the counts of each distinct length, never from a group's rows."""
    c = length_counts(df, by, F.length("text").cast("long"))
    lo, hi = at_index(F.floor((F.col("total") - 1) / 2)), at_index(F.floor(F.col("total") / 2))
    return c.groupBy(*by).agg(
        F.max("total").alias("n"), F.min("value").alias("min"), F.bround((lo + hi) / 2, 0).cast("long").alias("median"), at_index(quantile_index(0.75)).alias("p75"), at_index(quantile_index(0.9)).alias("p90"),
        F.bround(F.sum(F.col("value") * F.col("n")) / F.max("total"), 0).cast("long").alias("mean"), F.max("value").alias("max"))


def box_stats(df: DataFrame, by: list[str]) -> DataFrame:
    """Quartiles by index (n // 4, 3n // 4), median, whiskers within 1.5 interquartile ranges, and how many lie outside."""
    c = length_counts(df, by, F.length("text").cast("long"))
    lo, hi = at_index(F.floor((F.col("total") - 1) / 2)), at_index(F.floor(F.col("total") / 2))
    q = c.groupBy(*by).agg(at_index(F.floor(F.col("total") / 4)).alias("q1"), at_index(F.floor(3 * F.col("total") / 4)).alias("q3"), ((lo + hi) / 2).alias("median"))
    q = q.withColumns({"_a": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), "_b": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})
    inside = (F.col("value") >= F.col("_a")) & (F.col("value") <= F.col("_b"))
    return c.join(q, by).groupBy(*by, "q1", "median", "q3").agg(F.min(F.when(inside, F.col("value"))).alias("whisker_low"), F.max(F.when(inside, F.col("value"))).alias("whisker_high"), F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("outliers"))


def fliers(df: DataFrame, by: list[str], id_col: str, most: int = 300, seed: str = "42") -> DataFrame:
    """``by, id_col, length`` of texts whose length lies outside the whiskers' fences: ``most`` of each group, by the hash of their id."""
    box = box_stats(df, by).select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("_low"), (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("_high"))
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    each = df.select(*by, id_col, F.length("text").cast("long").alias("length"))
    outside = each.join(F.broadcast(box), on).where((F.col("length") < F.col("_low")) | (F.col("length") > F.col("_high")))  # a row per group
    return smallest(outside.select(*by, id_col, "length"), by, id_col, most, seed)


def char_inventory(df: DataFrame, by: list[str]) -> DataFrame:
    """``char, code, n``: how often each character occurs."""
    chars = df.select(*by, F.explode(F.split("text", "")).alias("char")).where("char <> ''")
    return chars.groupBy(*by, "char").agg(F.count(F.lit(1)).alias("n"))


def ordered_inventory(df: DataFrame, by: list[str]) -> DataFrame:
    """``char_inventory`` with ``code`` and ``place``: characters of each group by code point."""
    n = char_inventory(df, by).withColumn("code", F.ascii("char"))
    return n.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy("code")))  # a row per distinct character


def char_categories(df: DataFrame, by: list[str]) -> DataFrame:
    """``category, chars, n``: how many different characters of each Unicode category a group has, and how often they occur."""
    n = char_inventory(df, by)
    kinds = n.select("char").distinct().select("char", character("char")["category"].alias("category"))
    return n.join(kinds, "char").groupBy(*by, "category").agg(F.count(F.lit(1)).alias("chars"), F.sum("n").alias("n"))


def stats_document(corpus: DataFrame, split: DataFrame, evaluation_only: tuple[str, ...] = ()) -> DataFrame:
    """The corpus statistics as one row: ``sources`` (samples and tokens of each), ``by_label`` (samples of each source, totals), ``total`` and
    ``splits`` (samples and tokens of each label). ``corpus(source, label, text)``, ``split(split, label, text)``; as many cells as there
    are sources, labels and splits."""
    cell = F.struct("samples", "tokens")
    a = sample_counts(corpus, ["source"]).agg(F.sort_array(F.collect_list(F.struct(F.col("source").alias("key"), F.col("source").isin(*evaluation_only).alias("evaluation_only"), "samples", "tokens"))).alias("sources"))
    b = sample_counts(corpus, ["source", "label"]).groupBy("label").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "samples")))).alias("by_source"), F.sum("samples").alias("total_samples"), F.sum("tokens").alias("total_tokens"))
    b = b.agg(F.map_from_entries(F.collect_list(F.struct("label", F.struct("by_source", "total_samples", "total_tokens")))).alias("by_label"), F.struct(F.sum("total_samples").alias("samples"), F.sum("total_tokens").alias("tokens")).alias("total"))
    c = sample_counts(split, ["split", "label"]).groupBy("split").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", cell)))).alias("labels"))
    c = c.agg(F.sort_array(F.collect_list(F.struct(F.col("split").alias("key"), F.map_entries("labels").alias("labels")))).alias("s"))
    c = c.select(F.transform("s", lambda x: F.struct(x["key"].alias("key"), F.map_from_entries(x["labels"]).alias("labels"))).alias("splits"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def entity_hits(df: DataFrame, text_col: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """``entity, n``: character references left in a text."""
    return df.select(*by, F.explode(F.regexp_extract_all(text_col, F.lit(f"({ENTITY})"), 1)).alias("entity")).groupBy(*by, "entity").agg(F.count(F.lit(1)).alias("n"))


def suspicious_chars(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``code, n, texts``: invisible characters and how many texts hold them."""
    marks = "".join(map(chr, SUSPICIOUS))
    hits = df.where(F.col("text").rlike(f"[{marks}]")).select(*by, F.regexp_extract_all("text", F.lit(f"([{marks}])"), 1).alias("found"))
    names = F.create_map(*(x for k, v in SUSPICIOUS.items() for x in (F.lit(chr(k)), F.lit(v))))
    each = hits.select(*by, F.explode(F.array_distinct("found")).alias("char"), "found").withColumn("k", F.size(F.filter("found", lambda x: x == F.col("char"))))
    return each.groupBy(*by, "char").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("texts")).withColumn("name", names[F.col("char")])


def first_examples(df: DataFrame, key: str, order: list[str], n: int = 10) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("place") <= n)


def display_sample(df: DataFrame, key: str, id_col: str, pool: int = 50, n: int = 5, seed: str = "42") -> DataFrame:
    """n rows of each key's first ``pool``, by hash."""
    first = first_examples(df, key, [id_col], pool)
    return first.withColumn("pick", F.row_number().over(W.partitionBy(key).orderBy(F.md5(F.concat(F.lit(seed + "|"), F.col(id_col).cast("string")))))).where(F.col("pick") <= n).drop("place")


def short_texts(df: DataFrame, least: int = 10) -> DataFrame:
    return df.where(F.length("text") < least)


def paragraphs(df: DataFrame, by: str, order: str, least: int = 50, most: int | None = None) -> DataFrame:
    """Paragraphs (lines) of ``least`` characters or more; with ``most``, the first so many of each group."""
    lines = df.select(by, order, F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("text", F.trim("text")).where(F.length("text") >= least)
    if most is None:
        return lines
    # how many paragraphs the texts before have says which texts take part; a text's own are numbered by themselves
    upto = first_texts(lines, by, order, most)
    some = lines.join(upto, lines[by].eqNullSafe(upto["_by"]) & lines[order].eqNullSafe(upto["_order"]))
    own = F.row_number().over(W.partitionBy(by, order).orderBy("line", "text"))
    return some.withColumn("place", own + F.col("_before")).where(F.col("place") <= most).drop("_by", "_order", "_before")


def first_texts(lines: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """``_by, _order, _before``: texts of each group in order that have fewer than ``most`` rows before them, and how many.

    Rows are counted per text; texts are sorted by ranges, a large group in many tasks, and counted up within a task and
    over the tasks before it, of which there is one row each."""
    sizes = lines.groupBy(F.col(by).alias("_by"), F.col(order).alias("_order")).agg(F.count(F.lit(1)).alias("_n"))
    spread = stage(sizes.repartitionByRange("_by", "_order").sortWithinPartitions("_by", "_order").withColumn("_part", F.spark_partition_id()), "texts-in-order")
    parts = spread.groupBy("_by", "_part").agg(F.sum("_n").alias("_p"))
    earlier = parts.select(F.col("_by").alias("_b"), F.col("_part").alias("_q"), (F.sum("_p").over(W.partitionBy("_by").orderBy("_part")) - F.col("_p")).alias("_e"))
    near = spread.join(F.broadcast(earlier.where(F.col("_e") < most)), spread["_by"].eqNullSafe(F.col("_b")) & (spread["_part"] == F.col("_q")))  # a row per group and task
    inside = F.sum("_n").over(W.partitionBy("_by", "_part").orderBy("_order")) - F.col("_n")
    return near.withColumn("_before", F.col("_e") + inside).where(F.col("_before") < most).select("_by", "_order", "_before")

"""A training corpus from raw documents: toxic documents go, overlapping lines go from the later document, one
document of each group of near copies stays, documents with benchmark passages go, and the rest is packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``, whatever others there are beside
``doc_id`` and ``text``; ``n_chars`` follows the text.

Edge cases: null and empty texts stay up to packing, where they are one token; of repeated rows one stays if they have
words; rows without an id are compared like others; an empty table passes every stage; a text of any length is handled
whole; of equal candidates the smallest id stays (ties).
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.llm import op1_packing, op3_line_dedup, op8_decontamination, op9_toxicity, op10_jaccard_join
from florilege.session import stage


FEW = 500_000  # documents that are broadcast rather than joined by a shuffle of texts
NEAR_WORDS = 5  # words of a shingle, and the similarity, of near copies
NEAR = Fraction(4, 5)


def _free(name: str, docs: DataFrame) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _like(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with ``n_chars`` following the text where there is one."""
    size = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return df.select(*(size.alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go. The model learns from the training rows only, as in the operator's own query;
    where the labels teach nothing (too few, or of one class), none goes."""
    model = op9_toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), train=op9_toxicity.crc_mod("doc_id", 5) != 0)
    if model.flat is not None:
        return docs
    scored = op9_toxicity.score(docs, model, out=(name := _free("toxicity", docs)))
    return scored.where(F.col(name) < 0.5).select(*(F.col(f"`{c}`") for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned common blocks go from the later document; a document that loses all its lines goes."""
    lines, gone = _free("_lines", docs), _free("_deleted", docs)
    got = op3_line_dedup.line_dedup(docs, lines_out=lines, deleted_out=gone).where((F.col(gone) == 0) | (F.col(gone) < F.col(lines)))
    return _like(got, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the smallest id; rows that repeat it go, too. A document
    without words is in no group and stays. Near: five-word shingles, similarity 0.8 or more."""
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("_row")  # no name clashes with a key
    keyed = docs.select(F.col("doc_id").alias("_d"), F.xxhash64(F.col("text").cast("string")).alias("_h"), row)
    group = stage(op10_jaccard_join.jaccard_components(docs, words=NEAR_WORDS, threshold=NEAR).withColumnRenamed("doc_id", "_i"), "near-duplicates")
    first = group.where("n_shingles > 0").groupBy("_l").agg(F.min(F.struct("_i", "_h")).alias("m")).select(F.col("m._i").alias("_a"), F.col("m._h").alias("_b"))
    each = group.groupBy("_i", "_h").agg(F.count(F.lit(1)).alias("rows"), F.max("n_shingles").alias("n"))
    stays = first.withColumn("stays", F.lit(True))
    fate = each.join(stays, F.col("_i").eqNullSafe(F.col("_a")) & (F.col("_h") == F.col("_b")), "left").withColumn("stays", F.coalesce("stays", F.col("n") == 0))
    # what goes, and what stays but is repeated (rows without words stay as they are): usually few rows, so the texts needn't move
    odd = stage(fate.where("NOT stays OR (rows > 1 AND n > 0)").select("_i", F.col("_h").alias("_g"), "stays"), "near-duplicates-odd")
    odd = F.broadcast(odd) if odd.count() <= FEW else odd
    same = F.col("_d").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_g"))
    once = keyed.join(odd, same, "left_anti")
    again = keyed.join(odd.where("stays"), same, "left_semi").dropDuplicates(["_d", "_h"])
    return once.unionByName(again).select(*(F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document with words inside a benchmark passage goes."""
    return op8_decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, placed in sequences."""
    import public_tokenizers

    return op1_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: the tokenizer and the language models can't be written in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, step) in enumerate(STAGES, 1):
        docs = step(spark, docs, sf_dir)
        docs = stage(docs, f"pipeline-{name}") if i < len(STAGES) else docs
    return docs

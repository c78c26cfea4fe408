"""Vocabulary and TF-IDF weights in long form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from florilege.functions import grams


def spaces(text: Column | str, char: tuple[int, int] | None = (1, 4), word: tuple[int, int] | None = (1, 1), library: bool = False) -> dict[str, Column]:
    """Feature spaces as arrays of terms. ``library``: n-grams as the training library counts them."""
    out = {}
    if char:
        out["char"] = (grams.char_grams_wb if library else grams.char_grams)(text, *char)
    if word:
        out["word"] = grams.word_grams(text, *word)
    return out


def term_counts(df: DataFrame, id_col: str, terms: dict[str, Column]) -> DataFrame:
    """``id, space, term, tf``: how often each term stands in each document. The spaces are exploded one by one, as plain
    strings: tagging every occurrence with its space would double the bytes before the map-side sums."""
    parts = [df.select(F.col(id_col).alias("id"), F.explode(c).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf")).select("id", F.lit(s).alias("space"), "term", "tf") for s, c in terms.items()]
    return reduce(DataFrame.unionByName, parts)


def counts(df: DataFrame, id_col: str, text_col: Column | str = "text", char: tuple[int, int] | None = (1, 4), word: tuple[int, int] | None = (1, 1), library: bool = False) -> DataFrame:
    """``id, space, term, tf`` of a model's spaces. Character n-grams lie inside words, so a document's words are counted
    first and each distinct one is cut up once, with its count as weight."""
    if library or not char:
        return term_counts(df, id_col, spaces(text_col, char, word, library))
    each = df.select(F.col(id_col).alias("id"), F.explode(grams.words(text_col)).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    inner = each.select("id", "tf", F.explode(grams.word_char_grams("term", *char)).alias("term")).groupBy("id", "term").agg(F.sum("tf").alias("tf"))
    out = inner.select("id", F.lit("char").alias("space"), "term", "tf")
    if word == (1, 1):
        return out.unionByName(each.select("id", F.lit("word").alias("space"), "term", "tf"))
    return out.unionByName(term_counts(df, id_col, spaces(text_col, None, word))) if word else out


def vocabulary(counts: DataFrame, n_docs: int | Column, limits: dict[str, int] | None = None, min_df: dict[str, int] | None = None) -> DataFrame:
    """``space, term, df, tf, idf, idx``: terms with at least ``min_df`` documents, the ``limits`` most frequent of each
    space (ties by term); idx is alphabetical. The result has as many rows as the limits add up to."""
    return top_terms(counts.groupBy("space", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf")), n_docs, limits, min_df)


def top_terms(df: DataFrame, n_docs: int | Column, limits: dict[str, int] | None = None, min_df: dict[str, int] | None = None) -> DataFrame:
    """The same from ``space, term, df, tf``."""
    least = F.lit(1)
    for s, n in (min_df or {}).items():
        least = F.when(F.col("space") == s, F.lit(n)).otherwise(least)
    df = df.where(F.col("df") >= least)
    if limits:
        parts = [df.where(F.col("space") == s).orderBy(F.desc("tf"), "term").limit(k) for s, k in limits.items()]
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return df.withColumn("idf", F.log((n + 1) / (F.col("df") + 1)) + 1).withColumn("idx", (F.row_number().over(W.partitionBy("space").orderBy("term")) - 1).cast("int"))


#: numbers (terms by columns) of a table that goes to every executor; a larger one meets the terms by a shuffle
SMALL = 8_000_000


def by_term(table: DataFrame, terms: DataFrame, width: int) -> DataFrame:
    """``table``, a row per term of the vocabulary ``terms``, ready to meet term counts: broadcast if its size allows it, for a common term has a row in
    nearly every document and would be a hot key in a shuffle."""
    return F.broadcast(table) if terms.count() * width <= SMALL else table


def tfidf(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """``id, space, term, idx, w``: sublinear TF times IDF, each document's vector of norm 1 in each space."""
    raw = counts.join(by_term(vocab.select("space", "term", "idx", "idf"), vocab, 6), ["space", "term"]).withColumn("w", (1 + F.log(F.col("tf").cast("double"))) * F.col("idf"))
    # a document's terms are bounded by its text
    return raw.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id", "space")))).select("id", "space", "term", "idx", "w")

"""Sentences with characters foreign to their label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.functions.text import mask, sentences, tokens

#: fixed values: characters foreign to each label
FOREIGN = {
    "rm-sursilv": "äöüÄÖÜ",
    "rm-sutsilv": "äöüÄÖÜ",
    "rm-surmiran": "äöüÄÖÜ",
    "rm-rumgr": "äöüÄÖÜ",
    "rm-puter": "äÄ",
    "rm-vallader": "äÄ",
}
#: fixed values: names that may hold such characters, in the order in which they are masked
ALLOWED = (
    "Val Müstair", "Müstair", "Malögia", "Müller", "Jürg", "Jörg", "Bühler", "Brühl", "Valär", "Trübbach", "Jäger", "Fränzlis", "Fränzi", "Ardüser", "Tödi", "Altstätten", "Schütz", "Löwenberg",
    "Käthi", "Bütschwil", "Hansjörg", "Hansjürg", "Büchler", "Thöni", "Jörger", "Südostschweiz", "Schläpfer", "Rätia", "Bärtsch", "Neuhäusler", "Brändli", "Grüsch", "Hänny", "Göri",
)


def foreign_to(label: Column, c: Column, rules: dict[str, str]) -> Column:
    """Whether ``c`` holds a character foreign to the label; labels without a rule have none."""
    out = None
    for chars in sorted(set(rules.values())):
        names = [k for k, v in rules.items() if v == chars]
        hit = label.isin(*names) & c.rlike(f"[{chars}]")
        out = hit if out is None else out | hit
    return F.coalesce(out, F.lit(False)) if out is not None else F.lit(False)


def once(c: Column) -> Column:
    """``c`` as a generator of one row: projections and conditions above it don't compute it again, as they would a plain column."""
    return F.explode(F.array(c))


def judged(df: DataFrame, rules: dict[str, str] = FOREIGN, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Adds ``_sents`` (sentences of the masked text, only where it holds a foreign character)."""
    masked = df.select("*", once(mask("text", allowed)).alias("_m"))
    return masked.select("*", once(F.when(foreign_to(F.col("label"), F.col("_m"), rules), sentences("_m"))).alias("_sents"))


def _kept(label: Column, s: Column, rules: dict[str, str]) -> Column:
    return ~foreign_to(label, s, rules)


def foreign_filter(df: DataFrame, rules: dict[str, str] = FOREIGN, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Foreign sentences go from ``text``; a text of none but such goes. Texts without a foreign character stay as
    they were (unmasked); what is left of the others keeps its masks. Adds ``changed``."""
    j = judged(df, rules, allowed)
    left = F.trim(F.array_join(F.filter("_sents", lambda s: _kept(F.col("label"), s, rules)), " "))
    out = j.select("*", once(F.when(F.col("_sents").isNotNull(), left)).alias("_new"))
    return (
        out.where(F.col("_new").isNull() | (F.col("_new") != ""))
        .withColumns({"text": F.coalesce("_new", "text"), "changed": F.col("_new").isNotNull()}).drop("_m", "_sents", "_new")
    )


def foreign_triggers(df: DataFrame, rules: dict[str, str] = FOREIGN, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``word, count``: words with foreign characters in dropped sentences, most frequent first."""
    dropped = judged(df, rules, allowed).where(F.col("_sents").isNotNull()).select("label", F.explode("_sents").alias("s"))
    words = dropped.where(foreign_to(F.col("label"), F.col("s"), rules)).select("label", F.explode(tokens("s")).alias("word"))
    return words.where(foreign_to(F.col("label"), F.col("word"), rules)).groupBy("word").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "word")

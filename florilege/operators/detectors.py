"""Language detectors without training: markers, trigram ranks, dictionary coverage; one interface for all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from florilege.functions import grams
from florilege.functions.text import as_column, letter_tokens, share_of, utf16_left, utf16_length
from florilege.operators import trigrams
from florilege.session import stage

#: fixed values: markers of each variety, deleted in this order, and the percentages they must exceed
GERMAN, GERMAN_SHARE = ("ä",), 0.4
LADIN, LADIN_SHARE = ("ü", "ö", "s-ch", " pisser "), 0.4
PUTER, PUTER_SHARE = (" ho ", " fer ", " traunter ", "aunt ", " piglier ", "eau", "ted "), 0.04
SUTSILVAN, SUTSILVAN_SHARE = ("â", "ù"), 0.25
SURMIRAN, SURMIRAN_SHARE = ("ò ", " angal ", " chegl ", " chest ", " mianc ", " tgossa ", " eneda ", " neir ", " ena ", " sen "), 0.02
GRISCHUN, GRISCHUN_SHARE = ("à ", " è ", " èn ", "ì ", " da la ", " dal ", " cha", " qua ", "uai"), 0.25

MISSING = 300  # distance of a trigram that a profile lacks
#: Unicode scripts
LATIN, JAPANESE = r"\p{IsLatin}", r"\p{IsHiragana}\p{IsKatakana}"


#: fixed values: a trigram detector's language codes and the project's labels
PROJECT_LABELS = {
    "roh_rumgr": "rm-rumgr", "roh_puter": "rm-puter", "roh_surmiran": "rm-surmiran", "roh_sursilv": "rm-sursilv", "roh_sutsilv": "rm-sutsilv", "roh_vallader": "rm-vallader",
    "deu": "de", "fra": "fr", "ita": "it", "eng": "en",
}


def project_label(code: Column | str) -> Column:
    """A detector's code as a label; null for a code that no label stands for."""
    return F.create_map(*(F.lit(x) for kv in PROJECT_LABELS.items() for x in kv))[as_column(code)]


#: fixed values: the test set that holds other languages, and the languages that only it may be answered with
MIXED_SET = "test_e"


def candidates(test_set: Column | str, multilingual: bool = True) -> Column:
    """The labels a detector may answer with for a row, by its test set: the varieties, and in the multilingual mode's mixed set
    the other languages, too."""
    labels = list(PROJECT_LABELS.values())
    own = F.array(*(F.lit(x) for x in labels if x.startswith("rm-")))
    return F.when(as_column(test_set) == MIXED_SET, F.array(*(F.lit(x) for x in labels))).otherwise(own) if multilingual else own


def _may(candidates: str | None, lang: Column) -> Column:
    """Whether a row may be answered with a language: its candidates hold it, or it has none of its own."""
    return F.lit(True) if candidates is None else F.col(candidates).isNull() | F.array_contains(F.col(candidates), lang)


def marker_label(text: Column | str) -> Column:
    """A decision list over marker shares."""
    def over(marks, least):
        return share_of(text, marks) > least

    ladin = F.when(over(PUTER, PUTER_SHARE), "rm-puter").otherwise("rm-vallader")
    return (
        F.when(over(GERMAN, GERMAN_SHARE), "de").when(over(LADIN, LADIN_SHARE), ladin).when(over(SUTSILVAN, SUTSILVAN_SHARE), "rm-sutsilv")
        .when(over(SURMIRAN, SURMIRAN_SHARE), "rm-surmiran").when(over(GRISCHUN, GRISCHUN_SHARE), "rm-rumgr").otherwise("rm-sursilv")
    )


def trigram_profile(df: DataFrame, lang_col: str, text_col: str = "text", top: int = 300) -> DataFrame:
    """``lang, ord, trigram, rank``: each language's most frequent trigrams (ties by trigram); rank and ord from 0."""
    ranked = trigrams.totals(df, lang_col, text_col).withColumn("rank", (F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "trigram")) - 1).cast("int")).where(F.col("rank") < top)
    return ranked.withColumn("ord", (F.dense_rank().over(W.orderBy("lang")) - 1).cast("int")).select("lang", "ord", "trigram", "rank")  # top rows per language


def profile_rows(df: DataFrame) -> DataFrame:
    """A table (lang, ord, profile) with bar-separated trigrams as a profile table."""
    return df.select("lang", "ord", F.posexplode(F.split("profile", r"\|")).alias("rank", "trigram"))


def readable(text: Column | str, least: int = 10, longest: int | None = None) -> Column:
    """Whether a text is long enough (in UTF-16 units) and in Latin script: more Latin than Japanese letters, and any at all,
    among its first ``longest`` units."""
    t = as_column(text)
    return _readable(t, t if longest is None else utf16_left(t, longest), least)


def _readable(t: Column, seen: Column, least: int = 10) -> Column:
    latin, kana = F.regexp_count(seen, F.lit(f"[{LATIN}]")), F.regexp_count(seen, F.lit(f"[{JAPANESE}]"))
    return F.coalesce((utf16_length(t) >= least) & (latin > 0) & (latin >= kana), F.lit(False))


def trigram_distances(df: DataFrame, id_col: str, profile: DataFrame, text_col: str = "text", allowed: list[str] | None = None, longest: int | None = 2048, candidates: str | None = None, where: Column | None = None) -> DataFrame:
    """``id, lang, ord, distance, confidence``: the sum over a text's trigrams of |count - rank - 1|, 300 for those the
    profile lacks. The detector looks at the first 2048 UTF-16 units; ``longest=None`` reads all. ``allowed`` restricts the answers for all
    rows, ``candidates`` (a column of arrays, null: no restriction) row by row; both before distances become confidences. ``where`` (of the
    column ``text``, as it is read) says which texts are answered, in place of ``readable``.

    The profile (``top`` rows per language) goes to every task, which counts a text's trigrams where it lies. Rows that share their id are one
    text: those are counted by a shuffle."""
    langs = profile.select("lang", "ord").distinct()
    if allowed is not None:
        langs = langs.where(F.col("lang").isin(allowed))
    text = F.col(text_col) if longest is None else utf16_left(text_col, longest)
    own = [] if candidates is None else [F.col(candidates).alias("_may")]
    cut = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("_whole"), *own, F.explode(F.array(text)).alias("text"))  # a generator: cut once, not in every condition
    read = cut.where(_readable(F.col("_whole"), F.col("text")) if where is None else where).drop("_whole")
    again = stage(df.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_id"), "ids-again")
    if again.isEmpty():
        return _distances_in_place(read, profile, langs)
    same = read["id"].eqNullSafe(again["_id"])
    return _distances_in_place(read.join(again, same, "left_anti"), profile, langs).unionByName(_distances_by_id(read.join(again, same, "left_semi"), profile, langs))


def _distances_in_place(read: DataFrame, profile: DataFrame, langs: DataFrame) -> DataFrame:
    """``trigram_distances`` of rows with ids of their own."""
    names = [(r.lang, r.ord) for r in langs.collect()]  # a handful of languages
    entries: dict = {}
    for r in profile.where("trigram IS NOT NULL AND rank IS NOT NULL AND lang IS NOT NULL").select("lang", "trigram", "rank").collect():
        entries.setdefault(r.lang, []).append((r.trigram, r["rank"]))
    got = trigrams.known(read, [entries.get(x, []) for x, _ in names], MISSING)
    kind = "array<struct<lang:" + langs.schema["lang"].dataType.simpleString() + ",ord:" + langs.schema["ord"].dataType.simpleString() + ">>"
    answers = F.array(*(F.struct(F.lit(x).alias("lang"), F.lit(o).alias("ord")) for x, o in names)).cast(kind)
    each = F.transform("less", lambda less, i: F.struct(F.get(answers, i)["lang"].alias("lang"), F.get(answers, i)["ord"].alias("ord"), (F.col("kinds") * MISSING + less).alias("distance")))
    if "_may" in read.columns:
        each = F.filter(each, lambda x: _may("_may", x["lang"]))
    d = got.select("id", "kinds", each.alias("each")).select("id", "kinds", F.array_min(F.transform("each", lambda x: x["distance"])).alias("low"), F.inline("each"))
    return _confident(d, F.col("low"))


def _confident(d: DataFrame, low: Column) -> DataFrame:
    span = F.col("kinds") * MISSING - low
    return d.withColumn("confidence", F.when(span > 0, 1 - (F.col("distance") - low) / span).otherwise(0.0)).select("id", "lang", "ord", "distance", "confidence")


def _distances_by_id(read: DataFrame, profile: DataFrame, langs: DataFrame) -> DataFrame:
    """``trigram_distances`` where rows share ids (or have none): their counts meet by id."""
    own = "_may" in read.columns
    counts = read.select("id", F.explode(grams.trigrams("text")).alias("trigram")).groupBy("id", "trigram").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("id").agg(F.count(F.lit(1)).alias("kinds"))
    if own:
        may = read.select(F.col("id").alias("_i"), "_may").distinct()
        sizes = sizes.join(may, sizes["id"].eqNullSafe(may["_i"])).drop("_i")
    # what a language's profile knows of the text replaces the penalty
    known = counts.join(profile, "trigram").groupBy(F.col("id").alias("_i"), F.col("lang").alias("_l")).agg(F.sum(F.abs(F.col("n") - F.col("rank") - 1) - MISSING).alias("less"))
    every = sizes.crossJoin(F.broadcast(langs)).where(_may("_may" if own else None, F.col("lang")))  # documents by a handful of languages
    d = every.join(known, every["id"].eqNullSafe(known["_i"]) & (every["lang"] == known["_l"]), "left").withColumn("distance", F.col("kinds") * MISSING + F.coalesce("less", F.lit(0)))
    return _confident(d, F.min("distance").over(W.partitionBy("id")))


def trigram_label(df: DataFrame, id_col: str, profile: DataFrame, text_col: str = "text", allowed: list[str] | None = None, longest: int | None = 2048, candidates: str | None = None) -> DataFrame:
    """``id, lang``: the smallest distance, the first in profile order on ties; ``und`` for texts too short or in another script."""
    near = trigram_distances(df, id_col, profile, text_col, allowed, longest, candidates).groupBy("id").agg(F.min_by("lang", F.struct("distance", "ord")).alias("lang"))
    return df.select(F.col(id_col).alias("id")).join(near, "id", "left").withColumn("lang", F.coalesce("lang", F.lit("und")))


def lexicon(df: DataFrame, lang_col: str, text_col: str = "text", least_docs: int = 2) -> DataFrame:
    """``lang, word``: words that at least so many documents of a language hold."""
    words = df.select(F.col(lang_col).alias("lang"), F.explode(F.array_distinct(letter_tokens(text_col))).alias("word"))
    return words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_docs).select("lang", "word")


def spellings(word: str) -> Column:
    """The forms a spelling dictionary tries for a word: itself, and where its first letter is a capital the small one;
    a word in capitals also with only its first."""
    w = F.col(word)
    low, first = F.lower(w), F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))
    return F.array_distinct(F.array(w, F.when((w == first) | (w == F.upper(w)), low).otherwise(w), F.when(w == F.upper(w), first).otherwise(w)))


def accepted(df: DataFrame, id_col: str, words: DataFrame, text_col: str = "text", capitals: bool = False) -> DataFrame:
    """``id, word, n, langs``: each text's words, how often, and the languages that accept them (sorted; maybe none).
    ``capitals``: ``words`` is a spelling dictionary, whose words may begin a sentence or stand in capitals."""
    tokens = df.select(F.col(id_col).alias("id"), F.explode(letter_tokens(text_col)).alias("word")).groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"))
    if capitals:  # distinct words are looked up, not every token
        tried = tokens.select("word").distinct().select("word", F.explode(spellings("word")).alias("form"))
        words = tried.join(words.select("lang", F.col("word").alias("form")), "form").select("lang", "word")
    by_word = words.groupBy("word").agg(F.sort_array(F.collect_set("lang")).alias("langs"))
    return tokens.join(by_word, "word", "left").select("id", "word", "n", F.coalesce("langs", F.array().cast("array<string>")).alias("langs"))


def word_breakdown(df: DataFrame, id_col: str, words: DataFrame, text_col: str = "text", capitals: bool = False) -> DataFrame:
    """Per word: accepting languages, weight 1 / their number (0 if none), and whether none accepts it."""
    k = F.size("langs")
    return accepted(df, id_col, words, text_col, capitals).select("id", "word", "n", "langs", F.when(k > 0, 1 / k).otherwise(0.0).alias("weight"), (k == 0).alias("not_found"))


def coverage(df: DataFrame, id_col: str, words: DataFrame, text_col: str = "text", langs: list[str] | None = None, capitals: bool = False, candidates: str | None = None) -> DataFrame:
    """``id, lang, score``: a language's share of the weight of accepted words; all 0 where none is accepted. ``candidates``: a
    column of the languages a row may be answered with (null: all); the others keep their share of the weight, but give no row."""
    a = accepted(df, id_col, words, text_col, capitals).where(F.size("langs") > 0).withColumn("w", F.col("n") / F.size("langs"))
    total = a.groupBy("id").agg(F.sum("w").alias("total"))
    each = a.select("id", "w", F.explode("langs").alias("lang")).groupBy("id", "lang").agg(F.sum("w").alias("w"))
    names = words.select("lang").distinct() if langs is None else words.sparkSession.createDataFrame([(x,) for x in langs], "lang string")
    own = [] if candidates is None else [F.col(candidates).alias("_may")]
    every = df.select(F.col(id_col).alias("id"), *own).crossJoin(F.broadcast(names)).where(_may("_may" if own else None, F.col("lang"))).join(each, ["id", "lang"], "left").join(total, "id", "left")  # documents by a handful of languages
    return every.select("id", "lang", F.when(F.col("total") > 0, F.coalesce("w", F.lit(0.0)) / F.col("total")).otherwise(0.0).alias("score"))


def coverage_label(scores: DataFrame, order: dict[str, int] | None = None, allowed: list[str] | None = None, mixed: float | None = None) -> DataFrame:
    """``id, lang, score``: the best language (catalogue order on ties), ``und`` where all are 0; with ``mixed``, that
    label below the threshold."""
    s = scores if allowed is None else scores.where(F.col("lang").isin(allowed))
    place = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))[F.col("lang")] if order else F.col("lang")
    best = s.groupBy("id").agg(F.min_by(F.struct("lang", "score"), F.struct(-F.col("score"), place)).alias("b"))
    lang = F.when(F.col("b.score") == 0, "und").otherwise(F.col("b.lang"))
    if mixed is not None:
        lang = F.when(F.col("b.score") < mixed, "mixed").otherwise(F.col("b.lang"))
    return best.select("id", lang.alias("lang"), F.col("b.score").alias("score"))


#: detectors by name: each maps (df, id_col, text_col, **options) to (id, lang)
REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register(name: str, detector: Callable[..., DataFrame]) -> None:
    """Add a detector to the registry; the comparison takes all of them."""
    REGISTRY[name] = detector


register("markers", lambda df, id_col="id", text_col="text": df.select(F.col(id_col).alias("id"), marker_label(text_col).alias("lang")))
register("trigrams", lambda df, id_col="id", text_col="text", **o: trigram_label(df, id_col, text_col=text_col, **o))
register("coverage", lambda df, id_col="id", text_col="text", words=None, **o: coverage_label(coverage(df, id_col, words, text_col), **o).select("id", "lang"))


def register_sql(spark) -> None:
    """``marker_label(text)`` for SQL."""

    def share(marks):
        left = "t"
        for m in marks:
            left = f"replace({left}, '{m}', '')"
        return f"(CASE WHEN length(t) > 0 THEN (length(t) - length({left})) / (length(t) / 100.0D) ELSE 0D END)"

    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION marker_label(t STRING) RETURNS STRING RETURN CASE "
        f"WHEN {share(GERMAN)} > {GERMAN_SHARE} THEN 'de' WHEN {share(LADIN)} > {LADIN_SHARE} THEN CASE WHEN {share(PUTER)} > {PUTER_SHARE} THEN 'rm-puter' ELSE 'rm-vallader' END "
        f"WHEN {share(SUTSILVAN)} > {SUTSILVAN_SHARE} THEN 'rm-sutsilv' WHEN {share(SURMIRAN)} > {SURMIRAN_SHARE} THEN 'rm-surmiran' WHEN {share(GRISCHUN)} > {GRISCHUN_SHARE} THEN 'rm-rumgr' ELSE 'rm-sursilv' END"
    )

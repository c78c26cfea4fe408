"""Spelling dictionaries with affix rules, as a table of accepted forms.

A dictionary is a grammar <lang>.aff and a list of stems <lang>.dic. A rule of a class strips the end (SFX) or the start
(PFX) of a stem that meets its condition and adds letters; what it adds may carry classes of its own, which
apply once more (two suffixes, and a prefix in front). A suffix and a prefix of the stem combine if both classes
say so. Stems join rules on (language, class), so the expansion is a few joins, whatever the number of stems.

Read: FLAG (single characters, ``long``, ``num``), SFX, PFX, FULLSTRIP, NEEDAFFIX, ONLYINCOMPOUND, FORBIDDENWORD,
CIRCUMFIX. Not read: compounding, input conversion, numbered aliases of classes. A stem without a
grammar for its language is accepted as it stands, as is one whose classes have no rules; missing files accept nothing;
blank lines and the count at the head of a list are no stems.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.functions.text import squash
from florilege.session import stage
from florilege.sources.readers import _exists, _path

FEW = 200_000  # rules that are broadcast; more are joined by a shuffle
NONE = "cast(array() as array<string>)"


def _lang(folders: bool) -> Column:
    return F.regexp_extract(_path(), r"([^/]+)/[^/]+$" if folders else r"([^/]+)\.[a-z]+$", 1)


def _classes(flags: Column, kind: Column) -> Column:
    """The classes named by a string of flags."""
    named = F.when(kind == "long", F.regexp_extract_all(flags, F.lit("(..)"), F.lit(1))).when(kind == "num", F.split(flags, ",")).otherwise(F.split(flags, ""))
    return F.filter(F.coalesce(named, F.expr(NONE)), lambda x: x != "")


def _pattern(condition: Column) -> Column:
    """A condition (letters, dots and bracketed sets) as a regular expression."""
    return F.regexp_replace(condition, r"([\\{}()*+?|$&\-])", r"\\$1")


def grammar(spark: SparkSession, path: str, folders: bool = False) -> tuple[DataFrame, DataFrame]:
    """The options of each language (one row each) and its rules."""
    lines = spark.read.text(path).select(_lang(folders).alias("lang"), F.split(squash("value"), " ").alias("t"))
    lines = stage(lines.where(F.col("t")[0].isin("FLAG", "FULLSTRIP", "NEEDAFFIX", "ONLYINCOMPOUND", "FORBIDDENWORD", "CIRCUMFIX", "SFX", "PFX")), "affix-lines")

    def option(name: str) -> Column:
        return F.max(F.when(F.col("t")[0] == name, F.coalesce(F.get("t", F.lit(1)), F.lit(""))))

    names = {"kind": "FLAG", "full": "FULLSTRIP", "need": "NEEDAFFIX", "only": "ONLYINCOMPOUND", "bad": "FORBIDDENWORD", "circum": "CIRCUMFIX"}
    options = lines.groupBy("lang").agg(*(option(v).alias(k) for k, v in names.items()))
    t = F.col("t")
    affix = lines.where(t[0].isin("SFX", "PFX") & (F.size("t") >= 4)).select("lang", t[0].alias("at"), t[1].alias("class"), "t")
    head = t[2].isin("Y", "N") & t[3].rlike("^[0-9]+$")
    cross = affix.where(head).groupBy("lang", "at", "class").agg((F.max(t[2]) == "Y").alias("cross"))
    add, more = F.split(t[3], "/", 2)[0], F.get(F.split(t[3], "/", 2), F.lit(1))
    rules = affix.where(~head).join(cross, ["lang", "at", "class"], "left").join(F.broadcast(options), "lang").select(  # a row per language
        "lang", "at", "class", F.coalesce("cross", F.lit(False)).alias("cross"), F.when(t[2] == "0", "").otherwise(t[2]).alias("strip"), F.when(add == "0", "").otherwise(add).alias("add"),
        _classes(more, F.col("kind")).alias("more"), _pattern(F.coalesce(F.get("t", F.lit(4)), F.lit("."))).alias("cond"), F.col("full").isNotNull().alias("full"), "need", "circum",
    )
    return options, stage(rules, "affix-rules")


def stems(spark: SparkSession, path: str, options: DataFrame, folders: bool = False) -> DataFrame:
    """``lang, word, classes`` and what the language's options say of the stem."""
    value = F.regexp_replace(F.trim("value"), r"(\t| +[a-z]{2}:).*$", "")
    parts = F.split(F.regexp_replace(value, r"\\/", "\u0001"), "/", 2)
    rows = spark.read.text(path).select(_lang(folders).alias("lang"), F.trim(F.regexp_replace(parts[0], "\u0001", "/")).alias("word"), F.trim(F.get(parts, F.lit(1))).alias("flags"))
    rows = rows.where((F.col("word") != "") & ~(F.col("flags").isNull() & F.col("word").rlike("^[0-9]+$"))).join(F.broadcast(options), "lang", "left")
    rows = rows.withColumn("classes", _classes(F.col("flags"), F.col("kind")))

    def marked(name: str) -> Column:
        return F.coalesce(F.array_contains("classes", F.col(name)), F.lit(False))

    return rows.select("lang", "word", "classes", (marked("need") | marked("only")).alias("lone"), marked("bad").alias("forbidden"))


def _affixed(forms: DataFrame, rules: DataFrame, by: str, at: str) -> DataFrame:
    """Each form with each rule of the classes in the column ``by`` whose condition it meets."""
    chosen = rules.where(F.col("at") == at).drop("at")
    asked = forms.withColumn("class", F.explode(by))
    suffix = at == "SFX"
    meets = F.expr("word rlike concat(cond, '$')" if suffix else "word rlike concat('^', cond)")
    fits = F.endswith("word", F.col("strip")) if suffix else F.startswith("word", F.col("strip"))
    long = F.length("word") - F.length("strip")
    kept = F.substr("word", F.lit(1), long) if suffix else F.substr("word", F.length("strip") + 1, long)
    new = F.concat(kept, F.col("add")) if suffix else F.concat(F.col("add"), kept)
    return asked.join(chosen, ["lang", "class"]).where(meets & fits & ((long > 0) | F.col("full"))).withColumn("word", new)


def _has(classes: str, name: str) -> Column:
    return F.coalesce(F.array_contains(classes, F.col(name)), F.lit(False))


def lexicon(spark: SparkSession, grammars: str, lists: str, folders: bool = False) -> DataFrame:
    """``lang, word``: the accepted forms of every dictionary (paths may hold wildcards). A file's name is its language,
    or with ``folders`` that of the folder it is in."""
    if not _exists(spark, lists):
        return spark.createDataFrame([], "lang string, word string")
    nothing = "lang string, kind string, full string, need string, only string, bad string, circum string"
    if not _exists(spark, grammars):
        listed = stems(spark, lists, spark.createDataFrame([], nothing), folders)
        return listed.select("lang", "word").distinct()
    options, rules = grammar(spark, grammars, folders)
    rules = F.broadcast(rules) if rules.count() <= FEW else rules
    base = stage(stems(spark, lists, options, folders), "stems")
    empty = F.expr(NONE)
    # before: classes whose prefixes may come in front; half: one side of a circumfix, no word without the other
    plain = base.select("lang", "word", F.col("classes").alias("before"), F.lit(False).alias("after"), "lone", F.lit(False).alias("half"))
    first = _affixed(base.select("lang", "word", "classes"), rules, "classes", "SFX")
    once = first.select("lang", "word", F.when(F.col("cross"), F.col("classes")).otherwise(empty).alias("own"), "more", _has("more", "need").alias("lone"), _has("more", "circum").alias("half"))
    second = _affixed(once.select("lang", "word", "own", F.col("more").alias("classes")), rules, "classes", "SFX")
    twice = second.select("lang", "word", F.when(F.col("cross"), F.col("own")).otherwise(empty).alias("own"), "more", _has("more", "need").alias("lone"), _has("more", "circum").alias("half"))
    suffixed = once.unionByName(twice).select("lang", "word", F.array_union("own", "more").alias("before"), F.lit(True).alias("after"), "lone", "half")
    forms = plain.unionByName(suffixed)
    fronted = _affixed(forms.select("lang", "word", "before", "after", "half"), rules, "before", "PFX")
    fronted = fronted.where((~F.col("after") | F.col("cross")) & (F.col("half") == _has("more", "circum")) & ~_has("more", "need"))
    every = forms.where("NOT lone AND NOT half").select("lang", "word").unionByName(fronted.select("lang", "word"))
    return every.distinct().join(base.where("forbidden").select("lang", "word").distinct(), ["lang", "word"], "left_anti")

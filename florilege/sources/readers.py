"""Readers with explicit schemas. All give ``source, label, text`` (and what else they know); none infers a schema,
and all go through Spark's own readers, so any file system Spark knows will do. A missing path gives an empty table
where the format allows for it."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.functions.text import has_letter, normalize, squash, strip_markup, strip_signature, textbook
from florilege.session import stage

#: fixed values: the varieties
VARIETIES = ("rm-sursilv", "rm-sutsilv", "rm-surmiran", "rm-puter", "rm-vallader", "rm-rumgr")
#: fixed values: languages of the multilingual mode
LANGUAGES = ("de", "fr", "it", "en")
#: fixed values: last word of a dictionary file's name to variety
DICTIONARY_FILES = {"sursilvan": "rm-sursilv", "sutsilvan": "rm-sutsilv", "surmiran": "rm-surmiran", "rumantschgrischun": "rm-rumgr", "puter": "rm-puter", "vallader": "rm-vallader"}
#: fixed values: folder prefix of a transcript release to variety, with one misspelling that occurs
TRANSCRIPT_PREFIXES = {"rm": "rm-rumgr", "rmputer": "rm-puter", "rmsursilv": "rm-sursilv", "rmsursiv": "rm-sursilv", "rmsutsilv": "rm-sutsilv", "rmsurmiran": "rm-surmiran", "rmvallader": "rm-vallader"}

_CORPUS = "source string, label string, text string"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def _path() -> Column:
    return F.col("_metadata.file_path")


def _corpus(df: DataFrame, source: str, labels: tuple[str, ...] | None = VARIETIES) -> DataFrame:
    out = df if labels is None else df.where(F.col("label").isin(*labels))
    return lettered(out.select(F.lit(source).alias("source"), "label", "text"), "text")


def lettered(df: DataFrame, col: str) -> DataFrame:
    """The rows with a letter in ``col``, its last column. A condition would be pushed below the projection that normalises the text, which then
    ran twice, in two Python workers a task; a generator stays where it is."""
    return df.select(*(c for c in df.columns if c != col), F.explode(F.filter(F.array(col), has_letter)).alias(col))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], _CORPUS)


def news(spark: SparkSession, path: str, source: str = "fmr") -> DataFrame:
    """JSON lines ``variety, text``; a trailing editorial signature goes."""
    if not _exists(spark, path):
        return empty(spark)
    df = spark.read.schema("variety string, text string").json(path)
    text = strip_signature(normalize(F.coalesce("text", F.lit(""))))
    return _corpus(df.select(F.trim("variety").alias("label"), text.alias("text")), source)


def leaf_strings(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``id, place, leaf``: the strings in a JSON tree of objects; lists and what lies in them, numbers and null don't count.
    ``place`` holds the numbers of the fields on the way, so that its order is the text's own.

    A tree has any depth: each round opens the objects of one level, all inside the JVM. The text of a level is read twice, as
    strings (which keep order and nested text) and as variants (which tell a string from an object)."""
    level = df.select(F.col(id_col).alias("id"), F.array().cast("array<int>").alias("place"), F.col(json_col).alias("j"))
    found = []
    while True:
        values = F.map_values(F.from_json("j", "map<string,string>"))
        kinds = F.transform(F.map_values(F.from_json("j", "map<string,variant>")), F.schema_of_variant)
        opened = level.select("id", "place", F.posexplode(F.arrays_zip(values.alias("v"), kinds.alias("k"))).alias("n", "x")).select("id", F.array_append("place", F.col("n")).alias("place"), F.col("x.v").alias("j"), F.col("x.k").alias("kind"))
        opened = stage(opened.where("kind = 'STRING' OR startswith(kind, 'OBJECT')"), "tree")
        found.append(opened.where("kind = 'STRING'").select("id", "place", F.col("j").alias("leaf")))
        level = opened.where("kind <> 'STRING'").select("id", "place", "j")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)


def dictionary(spark: SparkSession, path: str, source: str = "pledari-grond", lines: bool = False) -> DataFrame:
    """JSON arrays of entries, one file per variety: headword, joined inflection forms and examples as rows. Entries
    whose headword begins with ``cf. `` are references and give nothing. ``lines``: an entry a line, in a folder of the file's name."""
    if not _exists(spark, path):
        return empty(spark)
    # the tree of forms has no schema: it is read as its JSON text
    raw = spark.read.schema("rmStichwort string, inflection string, examples array<struct<rm:string>>").option("multiLine", not lines).json(path)
    name = F.regexp_extract(_path(), r"([A-Za-z]+)\.json(?:/[^/]*)?$", 1)
    label = F.create_map(*(F.lit(x) for kv in DICTIONARY_FILES.items() for x in kv))[name]
    df = raw.withColumn("label", label).where(~F.coalesce(F.startswith("rmStichwort", F.lit("cf. ")), F.lit(False)))
    df = stage(df.withColumn("id", F.monotonically_increasing_id()), "entries")
    leaves = lettered(leaf_strings(df, "id", "inflection").withColumn("leaf", normalize("leaf")), "leaf")
    forms = leaves.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "leaf"))).alias("x")).select("id", F.array_join("x.leaf", " ").alias("text"))
    rows = (
        df.select("label", normalize(F.coalesce("rmStichwort", F.lit(""))).alias("text"))
        .unionByName(df.join(forms, "id").select("label", "text"))
        .unionByName(df.select("label", F.explode("examples").alias("e")).select("label", normalize(F.coalesce("e.rm", F.lit(""))).alias("text")))
    )
    return _corpus(rows, source)


def textbooks(spark: SparkSession, path: str, source: str = "textbooks") -> DataFrame:
    """JSON lines ``text`` in a folder per variety; exercise labels and gaps go."""
    if not _exists(spark, path):
        return empty(spark)
    df = spark.read.schema("text string").json(path).withColumn("label", F.regexp_extract(_path(), r"/([^/]+)/[^/]+$", 1))
    return _corpus(df.select("label", textbook(F.coalesce("text", F.lit(""))).alias("text")), source)


def plays(spark: SparkSession, path: str, source: str = "theater-plays") -> DataFrame:
    """JSON lines ``idiom, page_text``."""
    if not _exists(spark, path):
        return empty(spark)
    df = spark.read.schema("idiom string, page_text string").json(path)
    return _corpus(df.select(F.trim("idiom").alias("label"), normalize(F.coalesce("page_text", F.lit(""))).alias("text")), source)


def transcripts(spark: SparkSession, path: str, source: str = "rtr-transcripts") -> DataFrame:
    """TSV with header and quoting, column ``sentence``, in folders named <prefix>-cc-...; unknown prefixes drop out. The
    folder must exist."""
    df = spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    prefix = F.regexp_extract(_path(), r"/([^/]*?)-cc-[^/]*(?:/[^/]+)*$", 1)
    label = F.create_map(*(F.lit(x) for kv in TRANSCRIPT_PREFIXES.items() for x in kv))[prefix]
    return _corpus(df.select(label.alias("label"), normalize(strip_markup(F.coalesce("sentence", F.lit("")))).alias("text")), source)


def laws(spark: SparkSession, path: str, source: str = "canton-laws", label: str = "rm-rumgr") -> DataFrame:
    """JSON lines with the text under ``RM``; one label."""
    if not _exists(spark, path):
        return empty(spark)
    df = spark.read.schema("RM string").json(path)
    return _corpus(df.select(F.lit(label).alias("label"), normalize(F.coalesce("RM", F.lit(""))).alias("text")), source)


def encyclopedia(spark: SparkSession, path: str, source: str = "wikipedia") -> DataFrame:
    """JSON lines ``text``, a file (or folder) per language (<lang>.jsonl)."""
    if not _exists(spark, path):
        return empty(spark)
    df = spark.read.schema("text string").json(path).withColumn("label", F.regexp_extract(_path(), r"([a-z]+)\.jsonl?(?:/[^/]*)?$", 1))
    return _corpus(df.select("label", normalize(F.coalesce("text", F.lit(""))).alias("text")), source, LANGUAGES)


def tab_rows(spark: SparkSession, path: str) -> DataFrame:
    """``label, text`` of lines parted at their first tab; lines without one drop out."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).where(F.size(parts) == 2).select(F.trim(parts[0]).alias("label"), parts[1].alias("text"))


def proprietary(spark: SparkSession, path: str, source: str = "proprietary-data") -> DataFrame:
    """Headerless TSV files."""
    if not _exists(spark, path):
        return empty(spark)
    return _corpus(tab_rows(spark, path).withColumn("text", normalize("text")), source)


def preprocessed(spark: SparkSession, path: str, sources: list[str] | None = None, labels: list[str] | None = None) -> DataFrame:
    """A stage written by ``sinks.write_corpus``; the conditions prune partitions."""
    df = spark.read.parquet(path)
    df = df.where(F.col("source").isin(sources)) if sources else df
    return df.where(F.col("label").isin(labels)) if labels else df


def label_files(spark: SparkSession, path: str, source: str, labels: tuple[str, ...] | None = None) -> DataFrame:
    """Files ``<label>.tsv`` (or folders of that name) of one text a line: by default those of the varieties, ``rm-*``; with ``labels``, those of
    the encyclopedia's languages. Empty lines don't count."""
    if not _exists(spark, path):
        return empty(spark)
    label = F.regexp_extract(_path(), r"/([^/]+)\.tsv(?:/[^/]*)?$", 1)
    df = spark.read.text(path).select(F.lit(source).alias("source"), label.alias("label"), F.col("value").alias("text")).where("text <> ''")
    return df.where(F.col("label").isin(*labels)) if labels else df.where(F.startswith("label", F.lit("rm-")))


def split_file(spark: SparkSession, path: str) -> DataFrame:
    """``label, text`` of a split file; an absent file is an empty split."""
    return tab_rows(spark, path) if _exists(spark, path) else spark.createDataFrame([], "label string, text string")


def splits_meta(spark: SparkSession, path: str) -> DataFrame:
    """``multilingual, languages``; monolingual where there is no file."""
    schema = "multilingual boolean, languages array<string>"
    if not _exists(spark, path):
        return spark.createDataFrame([(False, [])], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def allow_list(spark: SparkSession, path: str) -> list[str]:
    """Terms of a list in file order, without comments and blank lines."""
    if not _exists(spark, path):
        return []
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    return [t for t in (x.strip() for x in text.split("\n")) if t and not t.startswith("#")]


#: one evaluation: what ``sinks.write_result`` writes
RESULT = "model string, name string, source string, timestamp string, test_sets map<string,struct<label:string,n_samples:bigint,accuracy:double,macro_f1:double,per_class:map<string,struct<f1:double,precision:double,recall:double,support:bigint>>>>"


def result_documents(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation files as they are, one row each; unreadable files are left out."""
    df = spark.read.schema(RESULT + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return df.where("_corrupt_record IS NULL AND test_sets IS NOT NULL").drop("_corrupt_record")


def result_classes(spark: SparkSession, path: str) -> DataFrame:
    """``model, set, class, f1, precision, recall, support`` of evaluation files."""
    df = result_documents(spark, path).select(F.coalesce("model", "name").alias("model"), F.explode("test_sets").alias("set", "r"))
    return df.select("model", "set", F.explode("r.per_class").alias("class", "c")).select("model", "set", "class", "c.*")


def results(spark: SparkSession, path: str) -> DataFrame:
    """``model, set, metric, value`` of evaluation files."""
    df = result_documents(spark, path).select(F.coalesce("model", "name").alias("model"), F.explode("test_sets").alias("set", "r"))
    return df.select("model", "set", F.explode(F.create_map(F.lit("accuracy"), F.col("r.accuracy"), F.lit("macro_f1"), F.col("r.macro_f1"))).alias("metric", "value"))


#: corpus statistics: what ``quality.stats_document`` makes
STATS = (
    "sources array<struct<key:string,evaluation_only:boolean,samples:bigint,tokens:bigint>>, by_label map<string,struct<by_source:map<string,bigint>,total_samples:bigint,total_tokens:bigint>>, "
    "total struct<samples:bigint,tokens:bigint>, splits array<struct<key:string,labels:map<string,struct<samples:bigint,tokens:bigint>>>>"
)


def stats_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATS).option("multiLine", True).json(path)


def stats_rows(spark: SparkSession, path: str) -> DataFrame:
    """``part, key, label, samples, tokens`` of corpus statistics, a row per cell."""
    d = stats_document(spark, path)
    none = F.lit(None).cast("string")
    a = d.select(F.inline("sources")).select(F.lit("source").alias("part"), "key", none.alias("label"), "samples", "tokens")
    b = d.select(F.explode("by_label").alias("label", "c"))
    cells = b.select("label", F.explode("c.by_source").alias("key", "samples")).select(F.lit("source and label").alias("part"), "key", "label", "samples", F.lit(None).cast("long").alias("tokens"))
    labels = b.select(F.lit("label").alias("part"), none.alias("key"), "label", F.col("c.total_samples").alias("samples"), F.col("c.total_tokens").alias("tokens"))
    total = d.select(F.lit("total").alias("part"), none.alias("key"), none.alias("label"), "total.samples", "total.tokens")
    c = d.select(F.inline("splits")).select("key", F.explode("labels").alias("label", "c")).select(F.lit("split").alias("part"), "key", "label", "c.samples", "c.tokens")
    return reduce(DataFrame.unionByName, (a, cells, labels, total, c))


def best_params(spark: SparkSession, path: str) -> dict:
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``lang, word`` from word lists <lang>.dic or .txt (affix flags after / are cut); missing lists accept nothing."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "lang string, word string")
    df = spark.read.text(path).select(F.regexp_extract(_path(), r"/([^/]+)\.[a-z]+$", 1).alias("lang"), F.trim(F.regexp_replace("value", "/.*$", "")).alias("word"))
    return df.where((F.col("word") != "") & ~F.col("word").rlike("^[0-9]+$")).distinct()


def articles(spark: SparkSession, path: str, least: int = 50, most: int = 100_000) -> DataFrame:
    """``lang, text``: paragraphs of articles (JSON lines ``lang, id, text``), the first ``most`` per language."""
    from florilege.operators.quality import paragraphs

    df = spark.read.schema("lang string, id long, text string").json(path)
    return paragraphs(df, "lang", "id", least, most).select("lang", "text")


def counted(spark: SparkSession, path: str) -> DataFrame:
    """``file, lines, tokens`` of text files."""
    df = spark.read.text(path).where(squash("value") != "")
    return df.groupBy(_path().alias("file")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.size(F.split(squash("value"), " "))).alias("tokens"))


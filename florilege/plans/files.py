"""Queries for readers, writers and text functions: the driver's documents go out in each format and come back through
its reader, so every row of a table passes, and SQL says what must come back.

A table's language stands for a variety (the readers accept known varieties only)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.functions import text
from florilege.operators import dedup, detectors, metrics, quality
from florilege.plans import corpus
from florilege.session import scratch
from florilege.sources import readers, sinks, spelling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

VARIETY = {"de": "rm-puter", "en": "rm-sursilv", "es": "rm-vallader", "fr": "rm-rumgr"}
AS_VARIETY = "CASE lang " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in VARIETY.items()) + " END"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def variety() -> Column:
    return F.create_map(*(F.lit(x) for kv in VARIETY.items() for x in kv))[F.col("lang")]


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "source", "text")


def place(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one."""
    return scratch(spark, f"files-{name}")


def marked(df: DataFrame) -> DataFrame:
    """Texts by hash: the rows of a format carry no ids."""
    return df.select("source", "label", F.md5("text").alias("text_md5"))


def normal(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '<[^>]+>', ' ', 'g'), 'https?://\\S+|www\\.\\S+', '$URL$', 'g'), '[0-9]+', '$NUM$', 'g'), '\\s+', ' ', 'g'))"


def cleaned(c: str) -> str:
    c = f"regexp_replace({c}, '\\$(NE|NUM|URL)\\$', ' ', 'g')"
    c = f"regexp_replace({c}, '[^\\p{{L}}\\p{{N}}_ \\-'']', ' ', 'g')"
    c = f"replace(replace(' ' || {c} || ' ', ' -', '  '), '- ', '  ')"
    return f"trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"


def _corpus(source: str, c: str, label: str = AS_VARIETY, where: str = "true") -> str:
    return f"SELECT '{source}' AS source, label, md5(t) AS text_md5 FROM (SELECT {label} AS label, {c} AS t FROM documents WHERE {where}) WHERE regexp_matches(t, '\\p{{L}}')"


# --- readers ------------------------------------------------------------------------------------


@query(_corpus("fmr", normal("text")))
def read_news(spark, sf):
    """JSON lines; every other text ends in an editorial signature, which goes."""
    to = place(spark, "news")
    signed = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" (abc/def)"))).otherwise(F.col("text"))
    documents(spark, sf).select(F.concat(F.lit(" "), variety()).alias("variety"), signed.alias("text")).write.json(to)
    return marked(readers.news(spark, to))


@query(_corpus("textbooks", f"trim({normal('text')})"))
def read_textbooks(spark, sf):
    """JSON lines in a folder per variety, with exercise labels and gaps, which go."""
    to = place(spark, "textbooks")
    rows = documents(spark, sf).select(variety().alias("v"), F.concat(F.lit("a) "), "text", F.lit(" ____ .....")).alias("text"))
    for v in VARIETY.values():
        rows.where(F.col("v") == v).select("text").write.json(f"{to}/{v}")
    return marked(readers.textbooks(spark, f"{to}/*"))


@query(_corpus("theater-plays", normal("text")))
def read_plays(spark, sf):
    to = place(spark, "plays")
    documents(spark, sf).select(variety().alias("idiom"), F.col("text").alias("page_text")).write.json(to)
    return marked(readers.plays(spark, to))


@query(_corpus("canton-laws", normal("text"), "'rm-rumgr'"))
def read_laws(spark, sf):
    to = place(spark, "laws")
    documents(spark, sf).select(F.col("text").alias("RM")).write.json(to)
    return marked(readers.laws(spark, to))


@query(_corpus("rtr-transcripts", normal("text"), "'rm-sutsilv'"))
def read_transcripts(spark, sf):
    """TSV with header and quotes; markup goes."""
    to = place(spark, "transcripts")
    rows = documents(spark, sf).select(F.lit("x.mp3").alias("path"), F.concat(F.lit("<i>"), "text", F.lit("</i>&nbsp;")).alias("sentence"))
    rows.write.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).csv(f"{to}/rmsutsilv-cc-1.0")
    return marked(readers.transcripts(spark, f"{to}/rmsutsilv-cc-1.0"))


@query(_corpus("proprietary-data", normal("text")))
def read_tab_rows(spark, sf):
    """Headerless lines, parted at the first tab."""
    to = place(spark, "rows")
    documents(spark, sf).select(F.concat_ws("\t", variety(), F.regexp_replace("text", r"[\r\n]", " ")).alias("value")).write.text(to)
    return marked(readers.proprietary(spark, to))


@query("WITH w AS (SELECT lang, unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: regexp_full_match(x, '[a-z]+'))) AS word FROM documents) SELECT DISTINCT lang, word FROM w")
def read_word_list(spark, sf):
    """Spelling lists with affix flags, one folder a language: one line a word."""
    to = place(spark, "words")
    words = documents(spark, sf).select("lang", F.explode(F.filter(text.tokens("text"), lambda x: x.rlike("^[a-z]+$"))).alias("w")).distinct()
    lists = []
    for lang in VARIETY:
        words.where(F.col("lang") == lang).select(F.concat("w", F.lit("/AB")).alias("value")).write.text(f"{to}/{lang}")
        lists.append(readers.lexicon(spark, f"{to}/{lang}/*.txt").select(F.lit(lang).alias("lang"), "word").distinct())
    return reduce(DataFrame.unionByName, lists)


@query(_corpus("wikipedia", normal("text"), "lang", "lang IN ('de', 'fr', 'en')"))
def read_encyclopedia(spark, sf):
    """JSON lines ``text, lang``, of the multilingual mode's languages."""
    to = place(spark, "encyclopedia")
    rows = documents(spark, sf)
    for lang in VARIETY:
        rows.where(F.col("lang") == lang).select("text", "lang").write.json(f"{to}/{lang}.jsonl")
    return marked(readers.encyclopedia(spark, f"{to}/*.jsonl"))


_LEAVES = "list_filter([{0}], lambda x: regexp_matches(x, '\\p{{L}}'))"


@query(f"""WITH d AS (SELECT {AS_VARIETY} AS label, doc_id, text, string_split(text, ' ') AS w FROM documents WHERE doc_id % 7 <> 0),
f AS (SELECT label, array_to_string({_LEAVES.format(", ".join(normal(c) for c in ("coalesce(w[2], '')", "coalesce(w[1], '')", "text")))}, ' ') AS t FROM d),
u AS (SELECT label, {normal("w[1]")} AS t FROM d UNION ALL SELECT label, t FROM f UNION ALL SELECT label, {normal("text")} FROM d)
SELECT 'pledari-grond' AS source, label, md5(t) AS text_md5 FROM u WHERE regexp_matches(t, '\\p{{L}}')""")
def dictionary_flatten(spark, sf):
    """Every document as a dictionary entry whose forms are a tree: headword, joined forms and examples come back as rows."""
    to = place(spark, "dictionary")
    w = F.split("text", " ")
    tree = F.struct(F.struct(F.coalesce(F.get(w, 1), F.lit("")).alias("z"), F.struct(F.get(w, 0).alias("y")).alias("a")).alias("pl"), F.array("text").alias("list"), F.lit(7).alias("n"), F.col("text").alias("b"))
    head = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("cf. "), "text")).otherwise(F.get(w, 0))
    rows = documents(spark, sf).select(variety().alias("v"), head.alias("rmStichwort"), tree.alias("inflection"), F.array(F.struct(F.col("text").alias("rm")), F.struct(F.lit(None).cast("string").alias("rm"))).alias("examples"))
    names = {v: k for k, v in readers.DICTIONARY_FILES.items()}
    for v in VARIETY.values():
        rows.where(F.col("v") == v).drop("v").write.json(f"{to}/export_{names[v]}.json")
    return marked(readers.dictionary(spark, f"{to}/*.json", lines=True))


@query(f"SELECT 'x' AS source, {AS_VARIETY} AS label, md5(t) AS text_md5 FROM (SELECT lang, replace(replace(text, chr(10), ' '), chr(13), ' ') AS t FROM documents) WHERE t <> '' AND lang <> 'en'")
def read_label_files(spark, sf):
    """Text files named after their label: those of the varieties count, others don't."""
    to = place(spark, "labels")
    rows = documents(spark, sf).select("lang", F.translate("text", "\n\r", "  ").alias("value"))
    for lang, v in VARIETY.items():
        rows.where(F.col("lang") == lang).select("value").write.text(f"{to}/{'other' if lang == 'en' else v}.tsv")
    return marked(readers.label_files(spark, f"{to}/*.tsv", "x"))


_STEMS = "(SELECT DISTINCT lang, word FROM (SELECT lang, unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: regexp_full_match(x, '[a-z]{2,}'))) AS word FROM documents))"
_FORMS = f"""WITH s AS {_STEMS},
f AS (SELECT lang, word, '' AS step FROM s UNION ALL SELECT lang, word || 's', 's' FROM s WHERE regexp_matches(word, '[^es]$') UNION ALL SELECT lang, left(word, length(word) - 1) || 'ing', 'i' FROM s WHERE word LIKE '%e'),
g AS (SELECT * FROM f UNION ALL SELECT lang, word || 's', 'is' FROM f WHERE step = 'i')
SELECT DISTINCT lang, word FROM (SELECT lang, word FROM g UNION ALL SELECT lang, 'un' || word FROM g WHERE regexp_matches(word, '^[aeiou]'))"""


def _dictionary(spark, sf) -> tuple[str, str]:
    """Grammar and word list of each language, in folders: every word of the documents is a stem of two classes."""
    to = place(spark, "spelling")
    rules = ("SET UTF-8", "SFX S Y 1", "SFX S 0 s [^es]", "SFX E Y 1", "SFX E e ing/S e", "PFX U Y 1", "PFX U 0 un [aeiou]")
    words = documents(spark, sf).select("lang", F.explode(F.filter(text.tokens("text"), lambda x: x.rlike("^[a-z]{2,}$"))).alias("w")).distinct()
    for lang in VARIETY:
        spark.createDataFrame([("\n".join(rules),)], "value string").coalesce(1).write.text(f"{to}/rules/{lang}")
        words.where(F.col("lang") == lang).select(F.concat("w", F.lit("/SEU")).alias("value")).write.text(f"{to}/list/{lang}")
    return f"{to}/rules/*/*.txt", f"{to}/list/*/*.txt"


@query(_FORMS)
def read_spelling_dictionary(spark, sf):
    """The forms that affix rules make of stems: suffixes, a suffix on a suffix, prefixes, both."""
    return spelling.lexicon(spark, *_dictionary(spark, sf), folders=True)


@query("WITH p AS (SELECT lang, doc_id, i, trim(x) AS t FROM (SELECT lang, doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE length(trim(x)) >= 50), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, i) AS k FROM p) SELECT lang, md5(t) AS text_md5 FROM r WHERE k <= 200")
def read_articles(spark, sf):
    to = place(spark, "articles")
    documents(spark, sf).select("lang", F.col("doc_id").alias("id"), "text").write.json(to)
    return readers.articles(spark, to, 50, 200).select("lang", F.md5("text").alias("text_md5"))


@query("SELECT count(*) AS lines, sum(len(list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '')))::BIGINT AS tokens FROM (SELECT replace(text, chr(10), ' ') AS t FROM documents) WHERE trim(t) <> ''")
def scan_lines_and_tokens(spark, sf):
    to = place(spark, "scan")
    documents(spark, sf).select(F.regexp_replace("text", r"\n", " ").alias("value")).write.text(to)
    return readers.counted(spark, to).agg(F.sum("lines").alias("lines"), F.sum("tokens").cast("long").alias("tokens"))


# --- writers ------------------------------------------------------------------------------------


@query("SELECT source, lang AS label, md5(text) AS text_md5 FROM documents WHERE source IN ('src0', 'src1') AND lang IN ('de', 'fr') GROUP BY source, lang, text")
def write_and_read_corpus(spark, sf):
    """Deduplicated and partitioned by source and label; the conditions of the reader prune partitions."""
    to = place(spark, "corpus")
    sinks.write_corpus(documents(spark, sf).select(F.col("doc_id").alias("seq"), "source", F.col("lang").alias("label"), "text"), to)
    return marked(readers.preprocessed(spark, to, ["src0", "src1"], ["de", "fr"]))


@query(f"SELECT lang AS label, md5(t) AS text_md5 FROM (SELECT lang, {cleaned('text')} AS t FROM documents) WHERE t <> ''")
def write_and_read_split(spark, sf):
    """A split as lines, texts cleaned for training, empty ones left out."""
    to = place(spark, "split")
    sinks.write_split(documents(spark, sf).select(F.col("lang").alias("label"), "text"), to, clean=True)
    return readers.split_file(spark, to).select("label", F.md5("text").alias("text_md5"))


@query(f"SELECT count(*) FILTER (t = '') AS skipped, count(*) AS samples FROM (SELECT {cleaned('text')} AS t FROM documents)")
def split_skipped(spark, sf):
    """Counted by the write itself: the documents are read once."""
    df = documents(spark, sf).select(F.col("lang").alias("label"), "text")
    got = sinks.write_split_counted(df, place(spark, "skipped"), clean=True)
    return spark.createDataFrame([(got["skipped"], got["samples"])], "skipped long, samples long")


@query("SELECT count(DISTINCT lang) > 0 AS multilingual, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages FROM documents")
def write_and_read_split_metadata(spark, sf):
    to = place(spark, "meta")
    langs = sorted(r.lang for r in documents(spark, sf).select("lang").distinct().collect())
    sinks.write_splits_meta(spark, langs, to)
    return readers.splits_meta(spark, to).select("multilingual", F.array_join("languages", ",").alias("languages"))


def _evaluated(spark, sf) -> str:
    """An evaluation of the documents as its JSON file."""
    to = place(spark, "results")
    e = documents(spark, sf).select(F.col("source").alias("set"), F.col("lang").alias("y"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(F.lit("en")).alias("p"))
    sinks.write_result(metrics.result_document(e, "constant", "documents", "2026-01-01T00:00:00Z", {"src0": "Source 0"}), to)
    return to


_EVALUATED = "(SELECT source AS \"set\", lang AS y, CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'en' END AS p FROM documents)"


@query(f"SELECT \"set\", 'accuracy' AS metric, round(avg((y = p)::INT), 6) AS value FROM {_EVALUATED} GROUP BY \"set\"")
def write_and_read_results(spark, sf):
    """An evaluation as its JSON document, and read back."""
    return readers.results(spark, _evaluated(spark, sf)).where("metric = 'accuracy'").select("set", "metric", "value")


@query(f"""WITH e AS {_EVALUATED}, t AS (SELECT "set", y AS class, count(*) AS support, count(*) FILTER (y = p) AS tp FROM e GROUP BY ALL), s AS (SELECT "set", p AS class, count(*) AS said FROM e GROUP BY ALL),
k AS (SELECT 'constant' AS model, "set", class, support, coalesce(tp / said, 0.0) AS p, tp / support AS r FROM t LEFT JOIN s USING ("set", class))
SELECT model, "set", class, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1, round(p, 6) AS precision, round(r, 6) AS recall, support FROM k""")
def result_document_classes(spark, sf):
    """Per-class figures of an evaluation that went through its JSON document."""
    return readers.result_classes(spark, _evaluated(spark, sf))


@query("""SELECT 'constant' AS name, 'documents' AS source, '2026-01-01T00:00:00Z' AS timestamp, source AS "set", CASE source WHEN 'src0' THEN 'Source 0' ELSE source END AS label, count(*) AS n_samples, count(DISTINCT lang) AS classes FROM documents GROUP BY documents.source""")
def result_document_sets(spark, sf):
    """What stands beside the figures: name, source, time, each set's label and size."""
    d = readers.result_documents(spark, _evaluated(spark, sf)).select("name", "source", "timestamp", F.explode("test_sets").alias("set", "r"))
    return d.select("name", "source", "timestamp", "set", "r.label", "r.n_samples", F.size("r.per_class").cast("long").alias("classes"))


@query("WITH w AS (SELECT unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS word FROM documents) SELECT count(*) || chr(9) || word AS line FROM w WHERE regexp_matches(word, '[äöü]') GROUP BY word")
def write_and_read_triggers(spark, sf):
    """Words with foreign characters, as the log of a filter: how often and which, one a line."""
    to = place(spark, "triggers")
    words = documents(spark, sf).select(F.explode(text.tokens("text")).alias("word")).where(F.col("word").rlike("[äöü]"))
    sinks.write_triggers(words.groupBy("word").agg(F.count(F.lit(1)).alias("count")), to)
    return spark.read.text(to).select(F.col("value").alias("line"))


@query("""WITH n AS (SELECT source, count(*) AS n, count(*) FILTER (doc_id % 3 = 0) AS k FROM documents GROUP BY source)
SELECT source, n AS rows, source IN ('src1', 'src3') AND k > 0 AS written, CASE WHEN source IN ('src1', 'src3') THEN k ELSE 0 END AS altered FROM n""")
def rewrite_changed_partitions(spark, sf):
    """A stage whose rows of two sources change: the partitions of the others aren't written again."""
    to = place(spark, "stage")
    d = documents(spark, sf).select("source", "doc_id", "text")
    sinks.rewrite_changed(d, to, ["source"])
    hit = F.col("source").isin("src1", "src3") & (F.col("doc_id") % 3 == 0)
    new = d.withColumn("text", F.when(hit, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")))
    written = [v for v, in sinks.rewrite_changed(new, to, ["source"])]
    back = spark.read.schema(d.schema).parquet(to).withColumn("altered", F.endswith("text", F.lit(" changed")))
    return back.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.count_if("altered").alias("altered")).withColumn("written", F.col("source").isin(written) if written else F.lit(False))


@query("""SELECT 'corpus' AS run, * FROM (SELECT 'read' AS step, 0 AS place, 'rows' AS counter, count(*) AS value FROM documents UNION ALL SELECT 'read', 0, 'chars', sum(length(text))::BIGINT FROM documents
UNION ALL SELECT 'with letters', 1, 'rows', count(*) FROM documents WHERE regexp_matches(text, '\\p{L}') UNION ALL SELECT 'long', 2, 'rows', count(*) FROM documents WHERE regexp_matches(text, '\\p{L}') AND length(text) >= 50)""")
def run_log(spark, sf):
    """Counters of a run, taken while its one write goes on, as a log that is read back."""
    log, to = sinks.RunLog("corpus"), place(spark, "run")
    d = log.watch(documents(spark, sf), "read", chars=F.sum(F.length("text")))
    d = log.watch(d.where(text.has_letter("text")), "with letters")
    d = log.watch(d.where(F.length("text") >= 50), "long")
    d.write.parquet(f"{to}/out")
    log.write(spark, f"{to}/log")
    return spark.read.schema("run string, step string, place int, counter string, value long").json(f"{to}/log")


_TOKENS = "len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))"


@query(f"""WITH d AS (SELECT source, lang AS label, {_TOKENS} AS t, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents)
SELECT 'source' AS part, source AS key, NULL AS label, count(*) AS samples, sum(t)::BIGINT AS tokens FROM d GROUP BY source UNION ALL SELECT 'source and label', source, label, count(*), NULL FROM d GROUP BY source, label
UNION ALL SELECT 'label', NULL, label, count(*), sum(t)::BIGINT FROM d GROUP BY label UNION ALL SELECT 'total', NULL, NULL, count(*), sum(t)::BIGINT FROM d UNION ALL SELECT 'split', split, label, count(*), sum(t)::BIGINT FROM d GROUP BY split, label""")
def write_and_read_stats(spark, sf):
    """Corpus statistics as their JSON document, and read back."""
    to = place(spark, "stats")
    d = documents(spark, sf).select("source", F.col("lang").alias("label"), "text", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"))
    sinks.write_result(quality.stats_document(d, d), to)
    return readers.stats_rows(spark, to)


# --- text functions -----------------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN p > 0 THEN CASE WHEN a > 1 THEN '…' ELSE '' END || substring(text, a, b - a + 1) || CASE WHEN b < length(text) THEN '…' ELSE '' END END AS cut FROM (SELECT doc_id, text, p, greatest(p - 70, 1) AS a, least(p + 2 + 70 - 1, length(text)) AS b FROM (SELECT doc_id, text, instr(text, 'en') AS p FROM documents))")
def excerpts(spark, sf):
    """The text around the first place of a term."""
    return documents(spark, sf).select("doc_id", text.excerpt("text", "en").alias("cut"))


@query("WITH r AS (SELECT source, avg((lang = 'en')::INT) AS a, avg((lang = 'de')::INT) AS b FROM documents GROUP BY source) SELECT source, CASE WHEN abs(b - a) < 0.001 THEN '≈' ELSE CASE WHEN b > a THEN '+' ELSE '' END || printf('%.3f', b - a) END AS delta FROM r")
def formatted_deltas(spark, sf):
    r = documents(spark, sf).groupBy("source").agg(F.avg((F.col("lang") == "en").cast("double")).alias("a"), F.avg((F.col("lang") == "de").cast("double")).alias("b"))
    return r.select("source", text.delta(F.col("a"), F.col("b")).alias("delta"))


@query("""SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS html, format('{:,}', length(text)) AS chars FROM documents""")
def escaped_texts(spark, sf):
    """Texts and their lengths as a report writes them."""
    return documents(spark, sf).select("doc_id", text.escaped("text").alias("html"), text.thousands(F.length("text")).alias("chars"))


@query("SELECT char, CASE WHEN regexp_matches(char, '\\p{Lu}') THEN 'Lu' WHEN regexp_matches(char, '\\p{Ll}') THEN 'Ll' WHEN regexp_matches(char, '\\p{Nd}') THEN 'Nd' ELSE 'other' END AS category, unicode(char)::INTEGER AS code FROM (SELECT DISTINCT unnest(string_split(text, '')) AS char FROM documents) WHERE char <> ''")
def character_categories(spark, sf):
    """Every character of the corpus with its category, by code point."""
    chars = documents(spark, sf).select(F.explode(F.array_distinct(F.split("text", ""))).alias("char")).where("char <> ''").distinct()
    kind = chars.withColumn("category", text.character("char")["category"])
    return kind.select("char", F.when(F.col("category").isin("Lu", "Ll", "Nd"), F.col("category")).otherwise("other").alias("category"), F.ascii("char").alias("code"))


@query("SELECT doc_id, regexp_matches(text, '\\p{L}') AS letters FROM documents")
def letter_check(spark, sf):
    return documents(spark, sf).select("doc_id", text.has_letter("text").alias("letters"))


@query(f"SELECT item_id, {normal('text')} AS text FROM benchmark")
def strip_exercise_marks(spark, sf):
    """Exercise labels and gaps around each benchmark text go."""
    t = F.concat(F.lit("a) "), text.normalize("text"), F.lit(" ___ ...."))
    return spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.trim(text.strip_blanks(text.strip_exercise_labels(t))).alias("text"))


# --- duplicates, detectors, evaluation ----------------------------------------------------------


@query("SELECT md5(text) AS text_md5, count(DISTINCT (source, lang)) AS places, count(*) AS rows FROM documents WHERE length(text) >= 40 AND source <> 'src4' GROUP BY text HAVING count(DISTINCT (source, lang)) > 1 ORDER BY rows DESC, text_md5 LIMIT 50")
def duplicate_candidates(spark, sf):
    """The report leaves out dictionaries, whose short entries repeat by nature."""
    d = documents(spark, sf).withColumnRenamed("lang", "label")
    return dedup.duplicate_report(d, without=("src4",)).select("text_md5", "places", "rows")


@query("WITH t AS (SELECT text, min(substring(source, 4)::INT) AS best, min(lang) <> max(lang) AS mixed FROM documents GROUP BY text) SELECT doc_id AS seq, mixed AS contradictory FROM documents JOIN t USING (text) WHERE mixed OR substring(source, 4)::INT > best")
def removed_by_dedup(spark, sf):
    """The rows that dedup across sources takes away, and why."""
    d = documents(spark, sf).select(F.col("doc_id").alias("seq"), "source", F.col("lang").alias("label"), "text")
    return dedup.removed(d, F.substring("source", 4, 9).cast("int")).select("seq", "contradictory")


@query("SELECT doc_id, CASE lang WHEN 'de' THEN 'de' WHEN 'fr' THEN 'fr' WHEN 'en' THEN 'rm-puter' END AS label FROM documents")
def detector_codes(spark, sf):
    """A detector's language codes as the project's labels; unknown ones have none."""
    codes = {"de": "deu", "fr": "fra", "en": "roh_puter", "es": "spa"}
    said = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))[F.col("lang")]
    return documents(spark, sf).select("doc_id", detectors.project_label(said).alias("label"))


@query("WITH d AS (SELECT 'test_' || substring('abcde', substring(source, 4)::INT % 5 + 1, 1) AS test_set FROM documents) SELECT multilingual, test_set, count(*) AS rows FROM d CROSS JOIN (VALUES (false), (true)) m(multilingual) WHERE multilingual OR test_set <> 'test_e' GROUP BY ALL")
def test_sets(spark, sf):
    """The rows of each registered test set: the encyclopedia's counts only in the multilingual mode."""
    d = documents(spark, sf).select(F.concat(F.lit("test_"), F.substr(F.lit("abcde"), F.substring("source", 4, 9).cast("int") % 5 + 1, F.lit(1))).alias("test_set"))
    modes = [d.where(F.col("test_set").isin(corpus.test_sets(m))).select(F.lit(m).alias("multilingual"), "test_set") for m in (False, True)]
    return modes[0].unionByName(modes[1]).groupBy("multilingual", "test_set").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT DISTINCT lang AS class FROM documents UNION SELECT 'xx' ORDER BY class")
def classes_seen(spark, sf):
    """Classes that any of several models' results hold, in order."""
    d = documents(spark, sf)
    return metrics.classes_seen([d.select(F.col("lang").alias("y")), spark.createDataFrame([("xx",)], "y string")])


@query("SELECT DISTINCT source AS \"set\", lang AS class, list_position(['fr', 'de', 'xx', 'en'], lang)::INTEGER AS place FROM documents WHERE lang IN ('fr', 'de', 'xx', 'en')")
def classes_in_order(spark, sf):
    """The classes of each set in canonical order."""
    d = documents(spark, sf).select(F.col("source").alias("set"), F.col("lang").alias("y"))
    return metrics.ordered_classes(d, ["set"], ["fr", "de", "xx", "en"])


@query("SELECT doc_id, md5(replace(replace(text, 'en', '$NE$'), 'a B', '$NE$')) AS text_md5 FROM documents")
def read_allow_list(spark, sf):
    """Terms of a file, without comments and blank lines, masked in file order wherever they stand."""
    to = place(spark, "allowed")
    spark.createDataFrame([("# c\n\nen \n a B\n#a\n",)], "value string").coalesce(1).write.text(to)
    return documents(spark, sf).select("doc_id", F.md5(text.mask("text", readers.allow_list(spark, to))).alias("text_md5"))


@query("SELECT 'min_df' AS name, min(n)::VARCHAR AS value FROM (SELECT count(*) AS n FROM documents GROUP BY lang) UNION ALL SELECT 'ngram_range', '[1,' || count(DISTINCT lang) || ']' FROM documents")
def write_parameters(spark, sf):
    """Parameters found from the data, as a file, and read back."""
    to = place(spark, "params")
    n = [r["count"] for r in documents(spark, sf).groupBy("lang").count().collect()]
    sinks.write_params(spark, {"min_df": min(n), "ngram_range": (1, len(n))}, to)
    return spark.createDataFrame([(k, str(v).replace(" ", "")) for k, v in readers.best_params(spark, to).items()], "name string, value string")

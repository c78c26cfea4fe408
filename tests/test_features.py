"""Trees of forms, result documents, changed partitions, run logs, candidates per row, UTF-16 cuts, samples by hash, streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from florilege.functions import text
from florilege.operators import dedup, detectors, metrics, quality, rank, splits
from florilege.sources import readers, sinks
from florilege.streaming import score as streaming


def leaves(x):
    return [y for v in x.values() for y in leaves(v)] if isinstance(x, dict) else [x] if isinstance(x, str) else []


TREES = [{"b": {"z": "zwei", "a": {"q": "{drei", "y": ["nein", {"k": "no"}], "x": "four"}}, "a": "...", "n": 7, "t": None, "l": ["no"], "e": {}}, {}, {"ü\"\\": "a\nbé\t\"c\"", "deep": {"d": {"d": {"d": {"d": "five"}}}}}, {str(k): f"v{k}" for k in range(30)}]


def test_leaf_strings_against_recursion(spark):
    rows = [(i, json.dumps(t)) for i, t in enumerate(TREES)] + [(90, "[1]"), (91, '"s"'), (92, None), (93, "{broken")]
    got = {}
    for r in readers.leaf_strings(spark.createDataFrame(rows, "k long, j string"), "k", "j").orderBy("id", "place").collect():
        got.setdefault(r.id, []).append(r.leaf)
    assert got == {i: leaves(t) for i, t in enumerate(TREES) if leaves(t)}


def test_dictionary_of_lines(spark, tmp_path):
    (tmp_path / "x_vallader.json").mkdir()
    (tmp_path / "x_vallader.json" / "part-1").write_text("\n".join(json.dumps({"rmStichwort": w, "inflection": {"pl": w + "s"}}) for w in ("chasa", "cf. chasa", "12")))
    got = sorted((r.label, r.text) for r in readers.dictionary(spark, f"{tmp_path}/x_vallader.json", lines=True).collect())
    # a headword of digits becomes a placeholder, which has letters
    assert got == [("rm-vallader", "$NUM$"), ("rm-vallader", "$NUM$s"), ("rm-vallader", "chasa"), ("rm-vallader", "chasas")]


def test_result_document_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("s", "a", "a"), ("s", "b", "a"), ("t", "b", "b")], "set string, y string, p string")
    sinks.write_result(metrics.result_document(df, "m", "pkg", "2026-01-02T03:04:05Z"), f"{tmp_path}/r")
    (part,) = [x for x in os.listdir(f"{tmp_path}/r") if x.startswith("part")]
    doc = json.loads((tmp_path / "r" / part).read_text())
    assert {k: doc[k] for k in ("name", "source", "timestamp")} == {"name": "m", "source": "pkg", "timestamp": "2026-01-02T03:04:05Z"}
    assert doc["test_sets"]["s"] == {"label": "s", "n_samples": 2, "accuracy": 0.5, "macro_f1": 0.333333, "per_class": {"a": {"f1": 0.666667, "precision": 0.5, "recall": 1.0, "support": 1}, "b": {"f1": 0.0, "precision": 0.0, "recall": 0.0, "support": 1}}}
    assert {(r.set, r["class"], r.support) for r in readers.result_classes(spark, f"{tmp_path}/r").collect()} == {("s", "a", 1), ("s", "b", 1), ("t", "b", 1)}
    assert {(r.model, r.set, r.metric, r.value) for r in readers.results(spark, f"{tmp_path}/r").collect()} == {("m", "s", "accuracy", 0.5), ("m", "s", "macro_f1", 0.333333), ("m", "t", "accuracy", 1.0), ("m", "t", "macro_f1", 1.0)}


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    rows = [(s, x, i, f"{s}{x}{i}") for s in ("p", "q") for x in ("l", "m") for i in range(5)]
    schema, at = "source string, label string, seq long, text string", f"{tmp_path}/stage"
    assert len(sinks.rewrite_changed(spark.createDataFrame(rows, schema), at, ["source", "label"])) == 4
    before = files(at)
    assert sinks.rewrite_changed(spark.createDataFrame(rows[::-1], schema), at, ["source", "label"]) == [] and files(at) == before
    new = [(s, x, i, t + "!" if (s, x, i) == ("q", "m", 3) else t) for s, x, i, t in rows] + [("q", "new", 1, "t")]
    assert sinks.rewrite_changed(spark.createDataFrame(new, schema), at, ["source", "label"]) == [("q", "m"), ("q", "new")]
    after = files(at)
    assert all(after.get(f) == t for f, t in before.items() if "source=q/label=m" not in f)
    assert sorted(map(tuple, spark.read.schema(schema).parquet(at).select("source", "label", "seq", "text").collect())) == sorted(new)
    # a row that is there twice is a change, too
    assert sinks.rewrite_changed(spark.createDataFrame([*new, new[0]], schema), at, ["source", "label"]) == [("p", "l")]


def test_run_log(spark, tmp_path):
    for run in ("one", "two"):
        log = sinks.RunLog(run)
        d = log.watch(spark.range(100), "all", even=F.count_if(F.col("id") % 2 == 0))
        log.watch(d.where("id < 10"), "few").write.parquet(f"{tmp_path}/{run}")
        log.write(spark, f"{tmp_path}/log")
    got = {(r.run, r.step, r.place, r.counter): r.value for r in spark.read.json(f"{tmp_path}/log").collect()}
    assert got == {(run, *k): v for run in ("one", "two") for k, v in {("all", 0, "rows"): 100, ("all", 0, "even"): 50, ("few", 1, "rows"): 10}.items()}


def test_split_is_counted_by_its_write(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame([("l", "A b!"), ("l", "..."), ("m", None)], "label string, text string").mapInArrow(count, "label string, text string")
    assert sinks.write_split_counted(df, f"{tmp_path}/s", clean=True) == {"samples": 3, "skipped": 2} and seen.value == 3


def test_candidates(spark):
    profile = spark.createDataFrame([(lang, i, t, k) for i, (lang, t3) in enumerate((("aa", ["abc", "bcd"]), ("bb", ["cde", "def"]), ("cc", ["abc", "xyz"]))) for k, t in enumerate(t3)], "lang string, ord int, trigram string, rank int")
    df = spark.createDataFrame([(1, "abcdefghijkl", None), (2, "abcdefghijkl", ["bb", "cc"]), (3, "abcdefghijkl", ["zz"]), (4, "short", ["aa"])], "id long, text string, may array<string>")
    got = {r.id: r.lang for r in detectors.trigram_label(df, "id", profile, candidates="may").collect()}
    assert got[1] == "aa" and got[2] in ("bb", "cc") and got[3] == got[4] == "und"
    d = detectors.trigram_distances(df, "id", profile, candidates="may").collect()
    assert {r.lang for r in d if r.id == 2} == {"bb", "cc"} and max(r.confidence for r in d if r.id == 2) == 1.0
    allowed = {r.id: r.lang for r in detectors.trigram_label(df.where("id = 1"), "id", profile, allowed=["bb", "cc"]).collect()}
    assert allowed[1] == got[2]
    words = spark.createDataFrame([("aa", "abcdefghijkl"), ("bb", "abcdefghijkl")], "lang string, word string")
    scores = {(r.id, r.lang): r.score for r in detectors.coverage(df, "id", words, candidates="may").collect()}
    assert scores == {(1, "aa"): 1.0, (1, "bb"): 1.0, (2, "bb"): 1.0, (4, "aa"): 0.0}
    policy = spark.createDataFrame([("test_a",), ("test_e",)], "s string").select("s", detectors.candidates("s").alias("c"), detectors.candidates("s", False).alias("m")).collect()
    assert {r.s: (len(r.c), len(r.m)) for r in policy} == {"test_a": (6, 6), "test_e": (10, 6)} and "de" in policy[1].c


def units(t, n):
    cut = t.encode("utf-16-be", "surrogatepass")[: 2 * n]
    return cut.decode("utf-16-be", "replace").replace("�", "")


def test_utf16_cut(spark):
    texts = ["", "abc", "😀" * 5, "a😀b😀c", "日本語😀", "é" * 10 + "😀", None]
    for n in (1, 2, 3, 4, 10, 11):
        got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.utf16_left("t", n).alias("c"), text.utf16_length("t").alias("k")).collect()
        assert {r.t: r.c for r in got} == {t: None if t is None else units(t, n) for t in texts}
        assert {r.t: r.k for r in got} == {t: None if t is None else len(t.encode("utf-16-be")) // 2 for t in texts}


def test_script_of_the_cut(spark):
    """Letters behind the cut have no say in the script, but the length is the whole text's."""
    rows = [(1, "word " * 460 + "カ" * 12_000), (2, "カ" * 2048 + "word " * 9000), (3, "a" * 9), (4, "😀" * 4 + "ab")]
    got = {r.id: r.ok for r in spark.createDataFrame(rows, "id long, t string").select("id", detectors.readable("t", longest=2048).alias("ok")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}


def test_null_keys_keep_their_rank(spark):
    df = spark.createDataFrame([(None, "l"), (1, "l"), (2, "l"), (None, None)], "k long, label string")
    got = splits.by_ratio(df, "k", 0.34).collect()
    assert sorted(r.split for r in got if r.label == "l") == ["test", "train", "train"] and len(got) == 4


def test_smallest(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3 == 0).alias("g")).unionByName(spark.createDataFrame([(7, None)], "id long, g boolean"))
    want = {}
    for r in rank.hash_ranked(df, ["g"], "id").where("rank <= 40").collect():
        want.setdefault(r.g, set()).add(r.id)
    got = {}
    for r in rank.smallest(df, ["g"], "id", 40).repartition(7).collect():
        got.setdefault(r.g, set()).add(r.id)
    assert got == want and {k: len(v) for k, v in got.items()} == {True: 40, False: 40, None: 1}


def test_fliers(spark):
    rows = [(i, "x", "a" * (10 + i % 5)) for i in range(200)] + [(1000 + i, "x", "b" * (500 + i)) for i in range(40)]
    df = spark.createDataFrame(rows, "seq long, label string, text string")
    all_of_them = quality.fliers(df, ["label"], "seq").collect()
    assert {r.seq for r in all_of_them} == set(range(1000, 1040)) and quality.box_stats(df, ["label"]).first().outliers == 40
    some = {r.seq for r in quality.fliers(df, ["label"], "seq", most=7).collect()}
    assert len(some) == 7 and some <= {r.seq for r in all_of_them}


def test_first_paragraphs_of_a_large_group(spark):
    rows = [("l" if i % 4 else None, i, "\n".join(f"paragraph {i} {k} " + "x" * 50 for k in range(i % 5))) for i in range(300)]
    df = spark.createDataFrame(rows, "lang string, id long, text string").repartition(6)
    got = sorted((str(r.lang), r.place, r.text) for r in quality.paragraphs(df, "lang", "id", 50, 33).collect())
    want = []
    for lang in ("l", None):
        every = [p for la, _, t in rows if la == lang for p in t.split("\n") if len(p) >= 50]
        want += [(str(lang), k + 1, p) for k, p in enumerate(every[:33])]
    assert got == sorted(want)


def test_within_source_sorts_no_texts(spark):
    df = spark.createDataFrame([(3, "s", "l", "t", 1), (1, "s", "l", "t", 2), (2, "s", None, "t", 3), (4, "s", None, None, 4), (5, "s", None, None, 5)], "seq long, source string, label string, text string, more int")
    got = dedup.within_source(df)
    assert sorted((r.seq, r.more) for r in got.collect()) == [(1, 2), (2, 3), (4, 4)] and got.columns == df.columns
    assert "SortAggregate" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("late", ["1 hour"])
def test_distinct_texts_over_a_restart(spark, tmp_path, late):
    def batch(rows):
        spark.createDataFrame(rows, "at string, text string").select(F.to_timestamp("at").alias("at"), "text").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("at timestamp, text string").parquet(f"{tmp_path}/in")
        out = streaming.distinct_texts(stream, "at", late=late)
        q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((str(r["at"])[11:16], r.text) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert batch([("2024-01-01 10:00:00", "a"), ("2024-01-01 10:05:00", "b"), ("2024-01-01 10:05:00", "b")]) == [("10:00", "a"), ("10:05", "b")]
    # a new query from the same checkpoint remembers both, drops what is too late, and takes what is new
    assert batch([("2024-01-01 10:30:00", "a"), ("2024-01-01 10:31:00", "c"), ("2024-01-01 08:00:00", "old")]) == [("10:00", "a"), ("10:05", "b"), ("10:31", "c")]
    # once the watermark has passed a text's time for long enough, the text counts as new
    batch([("2024-01-01 15:00:00", "d")])
    assert batch([("2024-01-01 15:01:00", "a")]) == [("10:00", "a"), ("10:05", "b"), ("10:31", "c"), ("15:00", "d"), ("15:01", "a")]


def test_label_files(spark, tmp_path):
    for name, body in (("rm-puter.tsv", "Bun di\n\nsaira\n"), ("de.tsv", "Tag\n"), ("rm-x.txt", "no\n")):
        (tmp_path / name).write_text(body)
    assert sorted((r.source, r.label, r.text) for r in readers.label_files(spark, f"{tmp_path}/*.tsv", "s").collect()) == [("s", "rm-puter", "Bun di"), ("s", "rm-puter", "saira")]
    assert [(r.label, r.text) for r in readers.label_files(spark, f"{tmp_path}/*.tsv", "wikipedia", ("de", "fr")).collect()] == [("de", "Tag")]
    assert readers.label_files(spark, f"{tmp_path}/none/*.tsv", "s").count() == 0


def test_shuffled(spark):
    df = spark.range(200).withColumnRenamed("id", "k")
    got = [r.k for r in splits.shuffled(df.repartition(5), "k").collect()]
    assert sorted(got) == list(range(200)) and got != sorted(got) and got == [r.k for r in splits.shuffled(df.coalesce(1), "k").collect()]
    assert got != [r.k for r in splits.shuffled(df, "k", seed="7").collect()]


def test_inventory_in_order(spark):
    df = spark.createDataFrame([("l", "bA😀a1"), ("l", "é A"), ("m", "")], "label string, text string")
    got = [(r.char, r.n, r.code) for r in quality.ordered_inventory(df, ["label"]).orderBy("place").collect()]
    assert got == [(c, n, ord(c)) for c, n in ((" ", 1), ("1", 1), ("A", 2), ("a", 1), ("b", 1), ("é", 1), ("😀", 1))]
    assert {(r.category, r.chars, r.n) for r in quality.char_categories(df, ["label"]).collect()} == {("Zs", 1, 1), ("Nd", 1, 1), ("Lu", 1, 2), ("Ll", 3, 3), ("So", 1, 1)}


def test_stats_document(spark, tmp_path):
    df = spark.createDataFrame([("s", "a", "x y", "train"), ("s", "b", "x", "test"), ("t", "a", "x y z", "train")], "source string, label string, text string, split string")
    sinks.write_result(quality.stats_document(df, df, ("t",)), f"{tmp_path}/d")
    doc = readers.stats_document(spark, f"{tmp_path}/d").first().asDict(recursive=True)
    assert doc["sources"] == [{"key": "s", "evaluation_only": False, "samples": 2, "tokens": 3}, {"key": "t", "evaluation_only": True, "samples": 1, "tokens": 3}]
    assert doc["by_label"]["a"] == {"by_source": {"s": 1, "t": 1}, "total_samples": 2, "total_tokens": 5} and doc["total"] == {"samples": 3, "tokens": 6}
    assert doc["splits"] == [{"key": "test", "labels": {"b": {"samples": 1, "tokens": 1}}}, {"key": "train", "labels": {"a": {"samples": 2, "tokens": 5}}}]

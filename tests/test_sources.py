"""Readers and writers on files made here."""

import json

import pytest
from pyspark.sql import functions as F

from florilege.plans import corpus as plan
from florilege.sources import readers, sinks


def rows(df):
    return sorted((r.label, r.text) for r in df.collect())


def test_news(spark, tmp_path):
    f = tmp_path / "n.jsonl"
    f.write_text("\n".join(json.dumps(x) for x in ({"variety": " rm-puter ", "text": "Bun di &amp; buna saira. (abc/def)"}, {"variety": "xx", "text": "no"}, {"variety": "rm-puter", "text": "..."}, {"variety": "rm-puter"})))
    assert rows(readers.news(spark, str(f))) == [("rm-puter", "Bun di & buna saira.")]
    assert readers.news(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_dictionary(spark, tmp_path):
    f = tmp_path / "export_puter.json"
    f.write_text(json.dumps([{"rmStichwort": "chesa", "inflection": {"b": {"z": "chesas", "a": "chesa"}, "a": "...", "l": ["no"]}, "examples": [{"rm": "la chesa"}, {}]}, {"rmStichwort": "cf. chesa", "examples": [{"rm": "x"}]}]))
    assert rows(readers.dictionary(spark, str(f))) == [("rm-puter", "chesa"), ("rm-puter", "chesas chesa"), ("rm-puter", "la chesa")]


def test_transcripts(spark, tmp_path):
    for name in ("rmsursiv-cc-1", "zz-cc-1"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "validated.tsv").write_text('id\tsentence\n1\t"Bun ""di"" <i>qua</i>&nbsp;"\n')
    assert rows(readers.transcripts(spark, f"{tmp_path}/*/validated.tsv")) == [("rm-sursilv", 'Bun "di" qua')]


def test_tab_rows(spark, tmp_path):
    f = tmp_path / "p.tsv"
    f.write_text("rm-puter\ta\tb c\nno tab\nxx\tt\n")
    assert rows(readers.proprietary(spark, str(f))) == [("rm-puter", "a b c")]
    assert [tuple(r) for r in readers.split_file(spark, str(f)).collect()] == [("rm-puter", "a\tb c"), ("xx", "t")]
    assert readers.split_file(spark, str(tmp_path / "none")).count() == 0


def test_others(spark, tmp_path):
    (tmp_path / "rm-sutsilv").mkdir()
    (tmp_path / "rm-sutsilv" / "train.jsonl").write_text(json.dumps({"text": "a) Legia ____ ussa"}))
    assert rows(readers.textbooks(spark, f"{tmp_path}/rm-sutsilv/*.jsonl")) == [("rm-sutsilv", "Legia  ussa")]
    (tmp_path / "l.jsonl").write_text(json.dumps({"RM": "Lescha 3"}))
    assert rows(readers.laws(spark, str(tmp_path / "l.jsonl"))) == [("rm-rumgr", "Lescha $NUM$")]
    (tmp_path / "de.jsonl").write_text(json.dumps({"text": "Guten Tag"}))
    assert rows(readers.encyclopedia(spark, str(tmp_path / "de.jsonl"))) == [("de", "Guten Tag")]
    (tmp_path / "t.jsonl").write_text(json.dumps({"idiom": "rm-puter", "page_text": "Act"}))
    assert rows(readers.plays(spark, str(tmp_path / "t.jsonl"))) == [("rm-puter", "Act")]
    (tmp_path / "a.txt").write_text("# c\n\nVal \n B\n")
    assert readers.allow_list(spark, str(tmp_path / "a.txt")) == ["Val", "B"]
    assert readers.splits_meta(spark, str(tmp_path / "none")).first().multilingual is False
    with pytest.raises(FileNotFoundError):
        readers.best_params(spark, str(tmp_path / "none"))
    (tmp_path / "x.dic").write_text("2\nchesa/AB\nbun\n")
    assert sorted(r.word for r in readers.lexicon(spark, str(tmp_path / "x.dic")).collect()) == ["bun", "chesa"]


def test_results(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"model": "m", "test_sets": {"A": {"accuracy": 0.5, "macro_f1": 0.25}}}))
    (tmp_path / "2.json").write_text("{broken")
    got = {(r.model, r.set, r.metric, r.value) for r in readers.results(spark, f"{tmp_path}/[0-9]*.json").collect()}
    assert got == {("m", "A", "accuracy", 0.5), ("m", "A", "macro_f1", 0.25)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "s", "l", "A b!"), (2, "s", "l", "A b!"), (3, "s", "l", "$NUM$.")], "seq long, source string, label string, text string")
    sinks.write_corpus(df, f"{tmp_path}/c")
    assert readers.preprocessed(spark, f"{tmp_path}/c", ["s"], ["l"]).count() == 2
    assert sinks.write_split(df, f"{tmp_path}/s", clean=True) == 1
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/s").collect()) == ["l\ta b", "l\ta b"]
    sinks.write_splits_meta(spark, ["de"], f"{tmp_path}/m.json")
    assert readers.splits_meta(spark, f"{tmp_path}/m.json").first().languages == ["de"]
    assert readers.best_params(spark, f"{tmp_path}/m.json")["multilingual"] is True
    sinks.write_triggers(spark.createDataFrame([("x", 1), ("y", 2)], "word string, count long"), f"{tmp_path}/t")
    assert [r.value for r in spark.read.text(f"{tmp_path}/t").collect()] == ["2\ty", "1\tx"]


def test_corpus_plan(spark):
    part = spark.createDataFrame([("fmr", "rm-puter", f"text {i}") for i in range(10)] + [("laws", "rm-puter", "text 1")], "source string, label string, text string")
    built = plan.build([part], priority=F.when(F.col("source") == "fmr", 1).otherwise(2))
    assert built.count() == 10
    assert {r.split: r["count"] for r in plan.split(built).groupBy("split").count().collect()} == {"test_a": 2, "train": 8}


def test_readers_normalise_once(spark, tmp_path):
    """One Python node a reader: a condition on the normal form isn't computed by a second one below it."""
    from florilege.sources import readers

    spark.createDataFrame([("rm-puter", "Bun <b>d&igrave;</b> 1"), ("rm-puter", "12 <x> !"), ("xx", "abc"), ("rm-vallader", None)], "idiom string, page_text string").write.json(f"{tmp_path}/plays")
    df = readers.plays(spark, f"{tmp_path}/plays")
    assert [tuple(r) for r in df.collect()] == [("theater-plays", "rm-puter", "Bun dì $NUM$"), ("theater-plays", "rm-puter", "$NUM$ !")]
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1

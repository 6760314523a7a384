"""Cleaning, routing, file formats, inspection, suites and model calls."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tamarisk.functions import arabizi
from tamarisk.operators import labels as B
from tamarisk.operators import profile as P
from tamarisk.operators import scoring as M
from tamarisk.operators import suite as G
from tamarisk.sources import files


def test_rows_with_text(spark):
    df = spark.createDataFrame([("a", 1), (" b\u00a0", None), (None, 1), ("", 0), (" \u2003\n", 1)], "text string, label int")
    assert sorted(r.text for r in B.with_text(df).collect()) == [" b\u00a0", "a"]
    assert [r.text for r in B.with_text(df, label=True).collect()] == ["a"]
    assert sorted(r.text for r in B.with_text(df, strip=True).collect()) == ["a", "b"]
    known, unknown = B.routed(df)
    assert known.count() == 4 and unknown.count() == 1


def test_prepare(spark):
    rows = [("سلام عليكم", "yes"), ("hello there", "yes"), (None, "no"), ("  ", "no"), ("كلام جميل", "maybe"), ("نص", "no"), ("ا" * 5, "no"), ("نص آخر هنا", "هذا نص في مكان الوسم"), ("كلمة \ufffd هنا", "no"), ("@a سلام", "no")]
    df = spark.createDataFrame(rows, "words string, label string")
    clean, unknown = B.prepare(df, 0, "label", {"yes": 1, "no": 0}, "src")
    assert sorted((r.text, r.label) for r in clean.collect()) == sorted([("سلام عليكم", 1), ("كلمة هنا", 0), ("سلام", 0)])
    assert [tuple(r) for r in unknown.collect()] == [("كلام جميل", "maybe", "src")]
    assert B.prepare(df.where("false"), "words", "label", {"yes": 1}, "src")[0].count() == 0


def test_json_lines_in_a_json_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"text": "x", "n": 1}\n{"text": "y", "n": 2}\n')
    assert files.read_table(spark, f"{tmp_path}/a.json", json_lines=True).count() == 2
    (tmp_path / "b.json").write_text(json.dumps([{"text": "x"}, {"text": "y"}, {"text": "z"}], indent=1))
    assert files.read_table(spark, f"{tmp_path}/b.json").count() == 3


def test_many_files_and_inspection(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_text("text,label\nx,1\ny,\n")
    (tmp_path / "sub" / "b.tsv").write_text("text\tlabel\nz\t0\n")
    (tmp_path / "c.jsonl").write_text('{"text": "w", "label": "1"}\n')
    (tmp_path / "notes.md").write_text("no data")
    spark.createDataFrame([("p", "1")], "text string, label string").write.parquet(f"{tmp_path}/d.parquet")
    found = [p.rpartition("/")[2] for p in files.listed(spark, str(tmp_path))]
    assert {"a.csv", "b.tsv", "c.jsonl"} <= set(found) and "notes.md" not in found
    assert files.listed(spark, f"{tmp_path}/none") == [] and files.inspect_tree(spark, f"{tmp_path}/none") is None
    both = files.read_many(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/sub/b.tsv"])
    assert sorted(r.text for r in both.collect()) == ["x", "y", "z"]
    told = {(r.file.rpartition("/")[2], r.column): r for r in files.inspect_tree(spark, str(tmp_path)).collect()}
    own = told["a.csv", "label"]
    assert (own.nulls, own.distinct_values, own["values"], own.head) == (1, 1, {"1": 1}, ["1", "null"])


def test_inspect_and_distinct_parts(spark):
    df = spark.createDataFrame([(i, "a|b" if i % 2 else "b|c") for i in range(30)], "n int, source string")
    rows = {r.column: r for r in P.inspect(df).collect()}
    assert rows["n"]["values"] is None and rows["n"].distinct_values == 30 and rows["source"]["values"] == {"a|b": 15, "b|c": 15} and len(rows["n"].head) == 3
    assert P.distinct_parts(df, "source").first().n_parts == 3
    assert P.inspect(df.where("false")).count() == 2


def test_word_table(spark):
    words = arabizi.word_table(spark.createDataFrame([("Ya Sadi2i", "يا صديقي"), ("akh", "أخ"), (None, "x")], "latin string, arabic string"))
    df = spark.createDataFrame([("ya sadi2i",), ("3ala akh",)], "t string")
    assert [r.x for r in df.select(arabizi.transliterate(F.col("t"), words).alias("x")).collect()] == ["يا صديقي", "علا أخ"]
    assert all(spark.createDataFrame([(t,)], "t string").select(arabizi.is_arabizi(F.col("t")).alias("x")).first().x for t in ("sharm el", "7mar kbir", "nayek x"))


def test_adversarial_suite(spark):
    seeds = spark.createDataFrame([("idiot", 1, "insult", False), ("friend", 0, "kind", False), ("dog", 1, "animal", True)], "word string, expected int, category string, contextual boolean")
    rows = G.adversarial(seeds, [("s", "{}s")], ["you {}"], ["a {}"], ["the {}", "my {}", "{} here", "one {}"]).collect()
    by = {c: [r.text for r in rows if r.category == c] for c in ("insult", "kind", "animal")}
    assert {"idiot", "you idiot", "idiots"} <= set(by["insult"]) and len(by["insult"]) == 5
    assert {"friend", "a friend"} <= set(by["kind"]) and len(by["kind"]) == 3
    assert sorted(by["animal"]) == sorted(["the dog", "my dog", "dog here", "one dog"]) and all(r.expected == (r.category == "insult") for r in rows)


def test_hard_negatives_by_group(spark):
    texts = spark.createDataFrame([("tea", "drink"), ("cat", "animal")], "text string, category string")
    rows = G.hard_negatives(texts, {"drink": ["hot {}", "{} please"]}, obfs=("dots",)).collect()
    assert sorted(r.text for r in rows) == sorted(["hot tea", "tea please", "t.e.a", "c.a.t"]) and all(r.expected == 0 for r in rows)
    assert {r.text: r.expected for r in G.generate(spark.createDataFrame([("bad", 1, "en", "x"), ("ok", 0, "en", "y")], "word string, expected int, dialect string, category string"), [("bare", "{}")], ["you {}"], 40, carried=100, safe_frames=["so {}"]).collect()}.items() >= {"you bad": 1, "so ok": 0}.items()


@pytest.mark.parametrize("kind, wait", [("busy", 20.0), ("limited", 5.0), ("timeout", 1.0), ("other", 20.0)])
def test_waits_by_kind(kind, wait):
    waited, tries = [], []

    def model(texts):
        tries.append(1)
        raise M.ModelFailure(kind)

    assert M.patiently(model, ["a"], sleep=waited.append) == (None, kind)
    assert waited == [wait] * 3 and len(tries) == 4


def test_calls_end_and_recover():
    def slow(texts):
        time.sleep(0.5)

    assert M.patiently(slow, ["a"], retries=0, timeout=0.05) == (None, "no answer in 0.05 s")
    left = [ValueError("x"), ConnectionError("y")]

    def model(texts):
        if left:
            raise left.pop()
        return [[("Toxic", 1.0)]]

    assert M.patiently(model, ["a"], sleep=lambda s: None) == ([[("Toxic", 1.0)]], None)


def test_known_scores(spark):
    texts = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "text string")
    known = spark.createDataFrame([("a", "TOXIC", 0.9)], "text string, label string, score double")
    asked = []

    def scorer(df):
        asked.extend(r.text for r in df.collect())
        return df.select("text", F.lit("SAFE").alias("label"), F.lit(0.1).alias("score"))

    assert sorted(tuple(r) for r in M.score_new(texts, known, scorer).collect()) == [("a", "TOXIC", 0.9), ("b", "SAFE", 0.1)] and asked == ["b"]

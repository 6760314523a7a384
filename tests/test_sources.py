"""Readers, config, settings, streams and scoring on small files."""

import json

from pyspark.sql import functions as F

from tamarisk.operators import scoring
from tamarisk.sources import files, settings
from tamarisk.streaming import moderation


def test_read_and_standardize(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('t;l\n"x; y";Yes\nz;no\n\nq;maybe\n', encoding="utf-8")
    config = {"raw_path": str(path), "text_column": "t", "label_column": "l", "label_map": {"yes": 1, "no": 0}, "separator": ";"}
    assert [tuple(r) for r in files.load(spark, "own", config).orderBy("text").collect()] == [("q", None, "own", "Unknown"), ("x; y", 1, "own", "Unknown"), ("z", 0, "own", "Unknown")]


def test_formats(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("text\tlabel\na\t1\n")
    (tmp_path / "a.jsonl").write_text('{"text": "a", "label": 1}\n{"text": "b", "label": 0}\n')
    (tmp_path / "a.json").write_text('[{"text": "a", "label": 1}]')
    (tmp_path / "b.csv").write_text("a,1\n")
    assert files.read_table(spark, str(tmp_path / "a.tsv")).collect()[0].label == "1"
    assert files.read_table(spark, str(tmp_path / "a.jsonl")).count() == 2
    assert files.read_table(spark, str(tmp_path / "a.json")).count() == 1
    assert files.read_table(spark, str(tmp_path / "b.csv"), no_header=True).columns == ["text", "label"]
    spark.range(3).write.parquet(str(tmp_path / "tree/x.parquet"))
    assert files.read_tree(spark, str(tmp_path / "tree")).count() == 3
    files.write_csv(spark.range(2), str(tmp_path / "out"))
    files.write_json(spark.range(2), str(tmp_path / "outj"))
    assert spark.read.json(str(tmp_path / "outj")).count() == 2


def test_config(tmp_path):
    path = str(tmp_path / "c.json")
    assert files.read_config(path) == {}
    files.upsert_config(path, {"a": {"raw_path": "x"}})
    files.upsert_config(path, {"a": {"raw_path": "y"}, "b": {}})
    assert files.read_config(path)["a"]["raw_path"] == "y" and files.read_config(path)["b"]["dialect"] == "Unknown"


def test_settings(spark):
    df = spark.createDataFrame([(json.dumps({"mode": "x", "threshold": 2, "pin": "1"}),), ("{}",)], "j string")
    rows = df.select(settings.parse(F.col("j")).alias("s")).select("s.mode", "s.threshold").collect()
    assert [tuple(r) for r in rows] == [("blur", None), ("blur", None)]


def test_stream_blocks_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), []
    spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:01"), ("b", "2024-01-01 00:00:02")], "block_id string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(src)
    stream = spark.readStream.schema("block_id string, ts timestamp").parquet(src)
    q = moderation.moderate(moderation.distinct_blocks(stream), lambda b: b, lambda b, e: out.extend(b.collect()), str(tmp_path / "cp"), "0 seconds")
    q.processAllAvailable()
    q.stop()
    assert sorted(r.block_id for r in out) == ["a", "b"]


def test_scoring_errors_are_told(spark):
    def load():
        def model(texts):
            if "bad" in texts:
                raise RuntimeError("no")
            return [[("Toxic", 0.7), ("Safe", 0.3)] for _ in texts]

        return model

    df = spark.createDataFrame([("ok",), ("bad",), ("",)], "text string").repartition(3, "text")
    rows = {r.text: r for r in scoring.classify(df, load, batch=1).collect()}
    assert rows["bad"].scores is None and rows["bad"].error == "no" and rows[""].error
    assert rows["ok"].scores[0].score == 0.7
    one = spark.createDataFrame([([1.0, 3.0],)], "x array<double>").select(scoring.softmax(F.col("x")).alias("s")).first().s
    assert one.predicted == 1 and abs(one.confidence - 0.880797) < 1e-5


def test_baseline_learns(spark):
    train = spark.createDataFrame([("good day", 0), ("bad idiot", 1), ("nice day", 0), ("idiot here", 1)] * 5, "text string, label int")
    model = scoring.baseline(train, 1 << 10, 5)
    assert model.transform(train).where("prediction = label").count() == 20

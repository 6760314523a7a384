"""What a step costs: tests of plans and patterns, beside the results that other tests compare."""

from pyspark.sql import functions as F

from tamarisk.functions import text as T
from tamarisk.operators import html
from tamarisk.operators import labels as B
from tamarisk.operators import rules as R
from tamarisk.session import BATCH_ROWS

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_negated_class_counts(spark):
    """A negated class of several ranges is tested through interfaces that all threads of an executor share."""
    df = spark.createDataFrame([("aбا٣ x",), ("",), (None,)], "text string")
    out = df.select(T.script_ratio(F.col("text"), "a-z", "a-zа-я"), T.count_matching(F.col("text"), T.ARABIC))
    assert "[^" not in plan(out)
    assert [tuple(r) for r in out.collect()] == [(2 / 3, 2), (None, 0), (None, None)]
    assert "[^" not in plan(df.select(T.normalize(F.col("text"))))


def test_texts_are_made_once(spark):
    """Neither the text that is handed in nor the normalised one is made again for each filter on it."""
    df = spark.createDataFrame([("abcd efgh", "en")], "raw string, label string").select(F.translate("raw", "abcdefgh", "ابتثجحخد").alias("text"), "label")
    clean, unknown = B.prepare(df, "text", "label", {"en": 1}, "own")
    assert plan(clean).count("translate(raw") == plan(unknown).count("translate(raw") == 1
    assert plan(clean).count("_nfkc_unescape") <= 3  # the node of the UDF
    assert [r.text for r in clean.collect()] == ["ابتث جحخد"]


def test_pages_come_in_small_batches(spark):
    old = spark.conf.get(ROWS)
    try:
        spark.conf.set(ROWS, "10000")
        html.page_blocks(spark.createDataFrame([(1, "<p>a</p>")], "page_id long, html string"))
        assert spark.conf.get(ROWS) == str(BATCH_ROWS)
    finally:
        spark.conf.set(ROWS, old)


def test_queries_read_in_small_batches(spark, data):
    from tamarisk.plans import registry

    old = spark.conf.get(ROWS)
    try:
        for name in ("transliterate", "normalize_runtime"):
            spark.conf.set(ROWS, "10000")
            registry.QUERIES[name](spark, data)
            assert spark.conf.get(ROWS) == str(BATCH_ROWS)
    finally:
        spark.conf.set(ROWS, old)


def test_verdict_makes_a_text_once(spark):
    """Each layer reads the written text, so what it is made of is evaluated once."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        made.add(1)
        return text

    docs = spark.createDataFrame([(i, f"one two three{i} idiot") for i in range(20)], "doc_id long, text string").localCheckpoint().select("doc_id", told.asNondeterministic()("text").alias("text"))
    terms = spark.createDataFrame([("idiot", "exact", "word")], "term string, tier string, kind string")
    assert R.verdict(docs, terms, profile=None).where("layer = 'dict'").count() == 20
    assert made.value == 20
    made.value = 0
    scorer = lambda texts: texts.select("text", F.lit("TOXIC").alias("label"), F.lit(0.9).alias("score"))
    assert R.hybrid(docs, terms.where("false"), scorer).where("is_toxic").count() == 20
    assert made.value == 20

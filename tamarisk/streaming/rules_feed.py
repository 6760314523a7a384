"""Rules that change while a stream runs: versions in a table, and a journal of which batch was judged by which.

A version is written whole before it counts. Each micro-batch takes the newest version there is and
notes it before it judges; a batch that is run again after a failure takes the noted one, so it comes to the same
verdicts, and so does a replay of the whole stream from the journal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.functions import text as T
from tamarisk.sources.files import listed

DONE = "_SUCCESS"


def _complete(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of the folders ``name=<n>`` that were written whole."""
    return sorted(int(p.rsplit("/", 2)[1].removeprefix(f"{name}=")) for p in listed(spark, path, (DONE.lower(),)))


def publish(rules: DataFrame, path: str) -> int:
    """Write ``rules`` (term) as the next version and return its number."""
    spark = rules.sparkSession
    version = max(_complete(spark, path, "version"), default=0) + 1
    rules.select("term").distinct().write.mode("overwrite").parquet(f"{path}/version={version}")
    return version


def version_of(spark: SparkSession, rules: str, journal: str, epoch: int) -> int:
    """The version that a batch is judged by: the one it is noted with, else the newest, which is noted. 0, without rules, before the first."""
    if epoch not in _complete(spark, journal, "epoch"):
        version = max(_complete(spark, rules, "version"), default=0)
        spark.range(1).select(F.lit(version).alias("version")).write.mode("overwrite").parquet(f"{journal}/epoch={epoch}")
        return version
    return spark.read.parquet(f"{journal}/epoch={epoch}").first().version


def rules_of(spark: SparkSession, rules: str) -> DataFrame:
    """(version, term) of all versions; reading one version reads its files alone."""
    if not _complete(spark, rules, "version"):
        return spark.createDataFrame([], "version int, term string")
    return spark.read.schema("term string, version int").parquet(rules).select("version", "term")


def verdicts(rows: DataFrame, rules: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, version, is_toxic, culprit (the first word that is a term) of ``rows`` with ``version`` by the rules of that version."""
    words = rows.select(F.col(key), "version", F.posexplode(T.tokens(F.lower(text))).alias("i", "term"))
    hits = words.join(rules, ["version", "term"]).groupBy(key, "version").agg(F.min_by("term", "i").alias("culprit"))
    return rows.select(key, "version").join(hits, [key, "version"], "left").select(key, "version", F.col("culprit").isNotNull().alias("is_toxic"), "culprit")


def moderate(stream: DataFrame, rules: str, journal: str, sink: Callable[[DataFrame, int], None], checkpoint: str, key: str = "doc_id", text: str = "text", **trigger):
    """Start judging ``stream``; ``sink`` gets the verdicts of each micro-batch and its number, and should write a number once."""

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        version = version_of(spark, rules, journal, epoch)
        sink(verdicts(batch.withColumn("version", F.lit(version)), rules_of(spark, rules).where(F.col("version") == version), key, text), epoch)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "300 milliseconds"})).start()


def replay(rows: DataFrame, rules: str, journal: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The verdicts of rows with the ``epoch`` they came in, by what was in force then."""
    spark = rows.sparkSession
    noted = spark.read.schema("version int, epoch int").parquet(journal)
    return verdicts(rows.join(noted, "epoch"), rules_of(spark, rules), key, text)

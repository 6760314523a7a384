"""Queries that run a stream over a whole table, to its end, and return what it wrote.

Each stream gets a folder of its own under the shared one, which stays as long as the result is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.plans.catalog import query, table
from tamarisk.streaming import rules_feed, stateful


#: What a micro-batch reads of a table of many files, so that a key's rows of one batch fit into a worker.
BATCH_BYTES = 256 << 20


def stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The table as a stream: files in the order of their times, rows of a key in each query's own order within a batch."""
    # a pattern, as a stream's plain path has to be a folder and a table may be one file
    return spark.readStream.schema(table(spark, d, name).schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(f"{d}/{name}.parque[t]")


def written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    root = stateful.folder(spark, name)
    stateful.to_table(df, f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(df.schema).parquet(f"{root}/out")


def lockout_twin(at: str, success: str) -> str:
    """The state machine as a recursion from each user's try to the next."""
    return f"""WITH RECURSIVE t AS (SELECT user_id, event_id, {at} AS at, {success} AS success, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, '' AS outcome, CAST(0 AS BIGINT) AS fails, CAST(0 AS DOUBLE) AS until FROM (SELECT DISTINCT user_id FROM t)
  UNION ALL
  SELECT t.user_id, t.k, t.event_id, CASE WHEN t.at < s.until THEN 'locked' WHEN t.success THEN 'ok' ELSE 'fail' END,
    CASE WHEN t.at < s.until THEN s.fails WHEN t.success THEN 0 ELSE s.fails + 1 END,
    CASE WHEN t.at < s.until THEN s.until WHEN t.success THEN 0 WHEN s.fails >= 5 THEN t.at + least(30 * pow(2, s.fails - 5), 900) ELSE 0 END
  FROM s JOIN t ON t.user_id = s.user_id AND t.k = s.k + 1)
SELECT user_id, event_id, outcome, until AS locked_until FROM s WHERE k > 0"""


@query(lockout_twin("epoch_us(ts) / 4e8", "event_type = 'signup'"))
def lockout_stream(spark, d):
    """Tries at a four-hundredth of the events' pace, so that many fall into a lock."""
    events = stream(spark, d, "events")
    return written(stateful.lockouts(events.select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 4e8).alias("at"), (F.col("event_type") == "signup").alias("success"))), "lockouts")


MEMO_OF = 20


def idiots():
    """Stands for a model: half a point for each ``idiot``."""
    return lambda texts: [[("Toxic", p := min(1.0, t.lower().count("idiot") / 2)), ("Safe", 1 - p)] for t in texts]


@query(
    f"""WITH RECURSIVE t AS (SELECT source AS key, doc_id, md5(coalesce(text, '')) AS text, (length(lower(text)) - length(replace(lower(text), 'idiot', ''))) // 5 AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
s AS (SELECT key, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS doc_id, CAST(0 AS BIGINT) AS n, false AS hit, CAST([] AS VARCHAR[]) AS held FROM (SELECT DISTINCT source AS key FROM documents)
  UNION ALL
  SELECT t.key, t.k, t.doc_id, coalesce(t.n, 0), list_contains(s.held, t.text), CASE WHEN list_contains(s.held, t.text) THEN s.held ELSE list_append(s.held, t.text)[-{MEMO_OF}:] END
  FROM s JOIN t ON t.key = s.key AND t.k = s.k + 1)
SELECT key, doc_id, hit, CASE WHEN n > 1 THEN 'TOXIC' ELSE 'SAFE' END AS label, CASE WHEN n >= 2 THEN 1.0 ELSE n / 2.0 END AS score FROM s WHERE k > 0""",
    doubles="score",
)
def memo_stream(spark, d):
    """The documents of a source one after another, beside a memo so small that it forgets."""
    return written(stateful.remembered(stream(spark, d, "documents"), "source", "doc_id", idiots, capacity=MEMO_OF), "memo").select("key", F.col("seq").alias("doc_id"), "hit", "label", "score")


@query("SELECT event_type, event_id, k // 50 AS batch, CAST(k % 50 AS INT) AS place FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE k < n - n % 50")
def request_batches(spark, d):
    """Requests that were full; what is left of a queue waits for its timer."""
    out = written(stateful.batched(stream(spark, d, "events").select("event_type", "event_id"), "event_type", "event_id"), "batches")
    return out.where("reason = 'count'").select("event_type", "event_id", "batch", "place")


@query("SELECT event_id, user_id, event_type, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rank FROM events) WHERE rank <= 50")
def newest_stream(spark, d):
    events = stream(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    root = stateful.folder(spark, "newest")
    out = stateful.latest_to_table(stateful.newest(events, "user_id", 50, "event_id"), f"{root}/out", f"{root}/checkpoint", "user_id")
    return out.select("event_id", "user_id", "event_type", "value", F.col("rank").cast("long").alias("rank"))


@query()
def added_blocks(spark, d):
    """The pages as the first snapshot of each."""
    return written(stateful.added_blocks(stream(spark, d, "pages").select("page_id", F.lit(0).cast("long").alias("snapshot"), "html")), "blocks")


@query(
    """WITH v AS (SELECT word FROM (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))) AS word FROM documents) GROUP BY word HAVING count(*) BETWEEN 2 AND 3),
t AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents)),
h AS (SELECT doc_id, min_by(w[i], i) AS culprit FROM t WHERE w[i] IN (SELECT word FROM v) GROUP BY doc_id)
SELECT d.doc_id, 1 AS version, h.culprit IS NOT NULL AS is_toxic, h.culprit FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id"""
)
def moderated_stream(spark, d):
    """Documents judged by a published rule table: the words that two or three of them hold."""
    root = stateful.folder(spark, "moderated")
    words = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.array_remove(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), ""))).alias("term"))
    rules_feed.publish(words.groupBy("term").agg(F.count("*").alias("n")).where("n BETWEEN 2 AND 3"), f"{root}/rules")
    sink = lambda df, epoch: df.write.mode("overwrite").parquet(f"{root}/out/epoch={epoch}")
    q = rules_feed.moderate(stream(spark, d, "documents"), f"{root}/rules", f"{root}/journal", sink, f"{root}/checkpoint", availableNow=True)
    q.awaitTermination()
    return spark.read.schema("doc_id long, version int, is_toxic boolean, culprit string").parquet(f"{root}/out").select("doc_id", "version", "is_toxic", "culprit")

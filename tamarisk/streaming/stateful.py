"""Keyed state on a running stream: batches, a bounded memo, ring buffers, seen blocks, lockouts.

Each is a ``StatefulProcessor`` for ``transformWithStateInPandas``; its state lies in RocksDB under the
stream's checkpoint, so it survives executors and restarts, and only one key's bounded
part of it is in a worker at a time. Rows of a key are taken in the order of a column within a micro-batch.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from tamarisk.operators import html, scoring
from tamarisk.session import shared_dir
from tamarisk.streaming.moderation import OUTCOMES, Lockout

# How many texts make a request, how long the queue waits for more, and how many results are remembered.
BATCH, WAIT_MS, MEMO = 50, 300, 500
#: Rows that are handed back at once.
FRAME_ROWS = 10_000
STORE = "spark.sql.streaming.stateStore.providerClass"
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable")


class Batches(StatefulProcessor):
    """A queue for each key that is flushed at ``most`` rows, or ``wait_ms`` after the last row came."""

    def __init__(self, most: int = BATCH, wait_ms: int = WAIT_MS) -> None:
        self.most, self.wait_ms = most, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "seq long, payload string")
        self.flushed = handle.getValueState("flushed", "n long")

    def _flush(self, key: str, rows: pd.DataFrame, reason: str) -> Iterator[pd.DataFrame]:
        """The rows as requests of ``most``: many in a frame, as each frame and each look at the state costs far more than a row."""
        n = self.flushed.get()[0] if self.flushed.exists() else 0
        self.flushed.update((n + -(-len(rows) // self.most),))
        for at in range(0, len(rows), FRAME_ROWS):
            part = rows.iloc[at : at + FRAME_ROWS]
            k = np.arange(at, at + len(part))
            yield pd.DataFrame({"key": key, "batch": n + k // self.most, "place": (k % self.most).astype("int32"), "reason": reason, "seq": part.seq.to_numpy(), "payload": part.payload.to_numpy()})

    def _waiting(self) -> pd.DataFrame:
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        return pd.DataFrame(rows, columns=["seq", "payload"]).astype({"seq": "int64"})

    def handleInputRows(self, key, rows, timerValues):
        queue = pd.concat([self._waiting(), _in_order(rows, ["seq"])[["seq", "payload"]]], ignore_index=True)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        full = len(queue) - len(queue) % self.most
        if full:
            yield from self._flush(key[0], queue.iloc[:full], "count")
        if full < len(queue):
            self.waiting.put([(int(s), p) for s, p in queue.iloc[full:].itertuples(index=False)])
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        else:
            self.waiting.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.waiting.exists():
            queue = self._waiting()
            self.waiting.clear()
            yield from self._flush(key[0], queue, "time")

    def close(self) -> None:
        pass


def batched(stream: DataFrame, key: str, order: str, most: int = BATCH, wait_ms: int = WAIT_MS) -> DataFrame:
    """``stream``'s rows as requests: key, batch (from 0 in each key), place, reason (``count`` or ``time``) and the columns.

    No row is lost or sent twice: the queue is part of the checkpoint. A key's rows are in the order of
    ``order`` within a micro-batch, and micro-batches follow each other. Null keys are one key.
    """
    kind = stream.schema
    rows = stream.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(order).cast("long").alias("seq"), F.to_json(F.struct(*stream.columns)).alias("payload"))
    out = rows.groupBy("key").transformWithStateInPandas(Batches(most, wait_ms), "key string, batch long, place int, reason string, seq long, payload string", "append", "processingTime")
    return out.select("batch", "place", "reason", F.from_json("payload", kind).alias("row")).select("batch", "place", "reason", *(F.col(f"row.`{c}`") for c in stream.columns))


class Memo(StatefulProcessor):
    """Scores of the last ``capacity`` distinct texts of a key: the first that came in goes first, and being asked for again does not help it stay."""

    def __init__(self, load: Callable, capacity: int = MEMO, batch: int = BATCH, **patience) -> None:
        self.load, self.capacity, self.batch, self.patience, self.model = load, capacity, batch, patience, None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "text string", "label string, score double")
        self.queue = handle.getMapState("queue", "place long", "text string")
        self.ends = handle.getValueState("ends", "first long, next long")

    def handleInputRows(self, key, rows, timerValues):
        first, following = self.ends.get() if self.ends.exists() else (0, 0)
        own = _in_order(rows, ["seq"])
        # a miss is known by its place in ``asked`` until the model has answered
        asked: list[str] = []
        answers: list = []
        fresh: dict[str, int] = {}
        gone: set[str] = set()
        added: dict[int, str] = {}
        for text in own.text:
            if text in fresh:
                answers.append((True, fresh[text]))
            elif text not in gone and (old := self.known.getValue((text,))) is not None:
                answers.append((True, tuple(old)))
            else:
                if following - first >= self.capacity:
                    out = added.pop(first, None)
                    if out is None:
                        out = self.queue.getValue((first,))[0]
                        gone.add(out)
                    fresh.pop(out, None)
                    first += 1
                fresh[text] = len(asked)
                added[following] = text
                following += 1
                answers.append((False, len(asked)))
                asked.append(text)
        if asked and self.model is None:
            self.model = self.load()
        scored: list = []
        for at in range(0, len(asked), self.batch):
            part = asked[at : at + self.batch]
            made, error = scoring.patiently(self.model, part, **self.patience)
            scored += [(*scoring.reduced(s), None) for s in made] if made is not None else [(None, None, error)] * len(part)
        # what fell out leaves the state, what came in and stayed enters it
        old_first = self.ends.get()[0] if self.ends.exists() else 0
        for text in gone:
            self.known.removeKey((text,))
        for place in range(old_first, first):
            self.queue.removeKey((place,))
        for place, text in added.items():
            self.queue.updateValue((place,), (text,))
            label, score, _ = scored[fresh[text]]
            self.known.updateValue((text,), (label, score))
        self.ends.update((first, following))
        out = []
        for (hit, found), seq, text in zip(answers, own.seq, own.text, strict=True):
            label, score, error = scored[found] if isinstance(found, int) else (*found, None)
            out.append((key[0], seq, text, label, score, hit, error))
        yield pd.DataFrame(out, columns=["key", "seq", "text", "label", "score", "hit", "error"])

    def close(self) -> None:
        pass


def remembered(stream: DataFrame, key: str, order: str, load: Callable, text: str = "text", capacity: int = MEMO, batch: int = BATCH, **patience) -> DataFrame:
    """key, seq, text, label, score, hit, error of every row: the model (as in :func:`scoring.classify`) is only asked for what the key's memo does not hold.

    A failed call gives null and the error, and is remembered as such until it falls out. Null and empty texts are one text.
    """
    rows = stream.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(order).cast("long").alias("seq"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    schema = "key string, seq long, text string, label string, score double, hit boolean, error string"
    return rows.groupBy("key").transformWithStateInPandas(Memo(load, capacity, batch, **patience), schema, "append", "none")


class Newest(StatefulProcessor):
    """The ``most`` rows of a key with the greatest order, all told; a row that is repeated counts again."""

    def __init__(self, most: int) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "seq long, payload string")

    def handleInputRows(self, key, rows, timerValues):
        held = [tuple(r) for r in self.ring.get()] if self.ring.exists() else []
        for frame in rows:  # a frame at a time: no more than the ring and a frame are held
            held += [(int(s), p) for s, p in frame[["seq", "payload"]].itertuples(index=False)]
            held = sorted(held, key=lambda r: -r[0])[: self.most]
        self.ring.put(held)
        yield pd.DataFrame([(key[0], place, *r) for place, r in enumerate(held, 1)], columns=["key", "place", "seq", "payload"])

    def close(self) -> None:
        pass


def newest(stream: DataFrame, key: str, most: int, order: str) -> DataFrame:
    """The log of each key that a micro-batch has touched, as it stands after it: ``rank`` from 1, newest first, and the columns."""
    kind = stream.schema
    rows = stream.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(order).cast("long").alias("seq"), F.to_json(F.struct(*stream.columns)).alias("payload"))
    out = rows.groupBy("key").transformWithStateInPandas(Newest(most), "key string, place int, seq long, payload string", "update", "none")
    return out.select(F.col("place").alias("rank"), F.from_json("payload", kind).alias("row")).select("rank", *(F.col(f"row.`{c}`") for c in stream.columns))


class Added(StatefulProcessor):
    """The blocks of a page that no earlier snapshot of it had; ``ttl_ms`` after a block was last seen it counts as new again."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "hash string", "snapshot long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        out = []
        for r in _in_order(rows, ["snapshot", "block_id"]).itertuples(index=False):
            if not self.seen.containsKey((r.hash,)):
                out.append((key[0], r.snapshot, r.block_id, r.tag, r.text))
            self.seen.updateValue((r.hash,), (int(r.snapshot),))
        yield pd.DataFrame(out, columns=["page_id", "snapshot", "block_id", "tag", "text"])

    def close(self) -> None:
        pass


def added_blocks(snapshots: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """page_id, snapshot, block_id, tag, text of each block that a snapshot (page_id, snapshot long, html) adds to its page.

    Pages are parsed where they are read; the state of a page holds a hash for each of its blocks.
    A text that stands twice in a page is one block; null pages have none.
    """
    blocks = html.page_blocks(snapshots, "snapshot").withColumn("hash", F.sha2(F.concat_ws("\x00", "tag", "text"), 256))
    mode = "none" if ttl_ms is None else "processingTime"
    return blocks.groupBy("page_id").transformWithStateInPandas(Added(ttl_ms), "page_id long, snapshot long, block_id int, tag string, text string", "append", mode)


def lockouts(tries: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """:func:`moderation.replay` on a stream (user_id, event_id, at, success); ``ttl_ms`` after a user's last try the state is forgotten."""
    own = tries.select(F.col("user_id").cast("long"), F.col("event_id").cast("long"), F.col("at").cast("double"), F.col("success").cast("boolean"))
    return own.groupBy("user_id").transformWithStateInPandas(Lockout(ttl_ms), OUTCOMES, "append", "none" if ttl_ms is None else "processingTime")


@contextlib.contextmanager
def state_store(spark: SparkSession, idle: bool = True):
    """Streams that start inside keep their state in RocksDB, as keyed processors need, and without ``idle`` run no batch without rows; the settings are put back."""
    wanted = {STORE: ROCKSDB} | ({} if idle else {NO_DATA: "false"})
    old = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append all that is there now to a parquet folder, each row once; started again, it goes on where it ended.

    Timers only fire in a batch with rows here: a stream that waits for timers would never have seen all.
    """
    with state_store(stream.sparkSession, idle=False):
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def latest_to_table(stream: DataFrame, path: str, checkpoint: str, key: str) -> DataFrame:
    """What an updating stream last said of each key, after all that is there now."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    with state_store(stream.sparkSession, idle=False):
        q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    spark = stream.sparkSession
    every = spark.read.schema(StructType([*stream.schema.fields, StructField("epoch", IntegerType())])).parquet(path)
    last = every.groupBy(key).agg(F.max("epoch").alias("epoch"))
    return every.join(last, [key, "epoch"], "left_semi").drop("epoch")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for a stream's table and checkpoint under the shared one."""
    return f"{shared_dir(spark)}/tamarisk-stream-{name}-{uuid.uuid4().hex[:12]}"

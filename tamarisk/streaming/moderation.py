"""Moderation of a stream: each block once, in micro-batches, with counters and a lockout state machine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FREE_TRIES, FIRST_SECONDS, MOST_SECONDS = 5, 30, 900
OUTCOMES = "user_id long, event_id long, outcome string, locked_until double"


def distinct_blocks(stream: DataFrame, key: str = "block_id", time: str = "ts", horizon: str = "1 hour") -> DataFrame:
    """Each block once within the horizon; the state is bounded by it."""
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark([key])


def moderate(stream: DataFrame, judge: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: str = "300 milliseconds"):
    """Runs ``judge`` (which may read changed rules each time) on each micro-batch and hands the result to ``sink``."""

    def each(batch: DataFrame, epoch: int) -> None:
        sink(judge(batch), epoch)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()


def counters(stream: DataFrame, by: str) -> DataFrame:
    """Running counts, for the update or complete mode."""
    return stream.groupBy(by).agg(F.count("*").alias("n"))


def windowed(stream: DataFrame, by: str, time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))


def attempt(state: tuple[int, float], at: float, success: bool) -> tuple[tuple[int, float], str, float]:
    """(state, outcome, locked until) after a try at ``at`` seconds, from (fails, locked until).

    Beyond five fails each further one locks for 30 s, doubled each time, 15 minutes at most. Tries
    while locked don't count; a success starts over.
    """
    fails, until = state
    if at < until:
        return state, "locked", until
    if success:
        return (0, 0.0), "ok", 0.0
    fails += 1
    over = fails - FREE_TRIES
    until = at + min(FIRST_SECONDS * 2 ** (over - 1), MOST_SECONDS) if over > 0 else 0.0
    return (fails, until), "fail", until


def replay(tries: DataFrame) -> DataFrame:
    """(user_id, event_id, outcome, locked_until) of tries (user_id, event_id, at double, success), by user in order of time.

    A fold per user: the state of one try depends on all before. Users are independent, and one
    user's tries come sorted from the shuffle and are folded as a stream of Arrow batches.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, state = None, (0, 0.0)
        for frame in frames:
            rows = []
            for u, e, at, ok in frame.itertuples(index=False):
                if u != user:
                    user, state = u, (0, 0.0)
                state, outcome, until = attempt(state, at, bool(ok))
                rows.append((u, e, outcome, until))
            yield pd.DataFrame(rows, columns=["user_id", "event_id", "outcome", "locked_until"])

    own = tries.select("user_id", "event_id", F.col("at").cast("double"), F.col("success").cast("boolean"))
    return own.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id").mapInPandas(run, OUTCOMES)


class Lockout(StatefulProcessor):
    """The same state machine for ``transformWithStateInPandas``, keyed by user; see :func:`stateful.lockouts`."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("lockout", "fails int, until double", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        state = tuple(self.state.get()) if self.state.exists() else (0, 0.0)
        out = []
        for r in pd.concat(list(rows)).sort_values(["at", "event_id"]).itertuples(index=False):
            state, outcome, until = attempt(state, r.at, bool(r.success))
            out.append((key[0], r.event_id, outcome, until))
        self.state.update((int(state[0]), float(state[1])))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "outcome", "locked_until"])

    def close(self) -> None:
        pass

"""Shards of nearly equal bytes by a histogram sort.

Rows are ordered by a key of three longs: a hash of the text, the doc_id, and the row's number.
So equal texts lie next to each other, and a group of copies of any size can still be cut.
Splitters are found without sorting: tasks count the exact bytes of the rows between
candidate boundaries (*probes*), the counts of all tasks are added up, and the interval that holds a wanted
share of the bytes gets new probes, until a boundary lies within the tolerance. A splitter
goes down to doc_ids only inside one text's group, and to row numbers only inside repeated rows, so a group is
cut only where its edges are outside the tolerance. Then the rows are exchanged once, each to
the part that its key lies in, and sorted there.

A shard consists of ``parts`` parts, so no task gets a whole shard; rough splitters between
the parts come from the same counts. The driver sees counts for each probe, of which there are
a fixed number for each part.
"""

from __future__ import annotations

import dataclasses
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.llm import words as W
from tamarisk.llm.store import Scratch

SHARDS = 24
#: How far a shard's border may be from its exact place, in shares of a mean shard.
TOLERANCE = 0.002
#: The same for the borders of parts within a shard, in shares of a mean part.
ROUGH = 0.25
#: Probes for each interval and round.
PROBES = 64
#: Bytes that a row counts besides its text.
ROW_BYTES = 8
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
KEYS = ("_h", "_d", "_r")


@dataclasses.dataclass
class Wanted:
    """A border that is looked for: ``bytes`` of all rows shall lie before it.

    Below ``prefix``, which fixes the first keys, it is known to be a value from ``low`` to
    ``high`` of the next key, and ``before`` bytes lie below ``prefix`` and ``low``.
    """

    bytes: int
    slack: float
    prefix: tuple[int, ...] = ()
    low: int = LOWEST
    high: int = HIGHEST
    before: int = 0
    found: tuple[int, int, int] | None = None

    @property
    def interval(self) -> tuple:
        return (self.prefix, self.low, self.high)

    def settle(self, *values: int) -> None:
        self.found = (*values, *[LOWEST] * (len(KEYS) - len(values)))

    def narrow(self, counts: list[tuple[int, int, int, int]]) -> None:
        """Move on by the interval's (bytes, rows, least value, greatest value) between each two probes, in order, without empty ones."""
        below = self.before
        for i, (size, rows, low, high) in enumerate(counts):
            # either end of this stretch is a border between two values of the key
            if abs(below - self.bytes) <= self.slack:
                return self.settle(*self.prefix, low)
            if below + size > self.bytes or i == len(counts) - 1:
                after = below + size
                if low == high and (rows == 1 or len(self.prefix) == len(KEYS) - 1):
                    if self.bytes - below <= after - self.bytes:
                        return self.settle(*self.prefix, low)
                    return self.after(high)
                if abs(after - self.bytes) <= self.slack:
                    return self.after(high)
                self.before = below
                if low == high:
                    self.prefix, self.low, self.high = (*self.prefix, low), LOWEST, HIGHEST
                else:
                    self.low, self.high = low, high
                return None
            below += size
        return self.settle(*self.prefix, self.low)

    def after(self, value: int) -> None:
        """The border behind all rows with this value: the next value, or behind all rows that share the prefix."""
        values = [*self.prefix, value]
        while values and values[-1] == HIGHEST:
            values.pop()
        if not values:
            self.settle(HIGHEST, HIGHEST, HIGHEST)
        else:
            self.settle(*values[:-1], values[-1] + 1)


def probes(low: int, high: int, n: int = PROBES) -> list[int]:
    """``n`` values at most that cut [low, high] evenly; the first stretch starts at ``low``."""
    return sorted({low + (high - low + 1) * i // n for i in range(1, n)} - {low})


def histogram(rows: DataFrame, intervals: list[tuple]) -> dict[tuple, list[tuple[int, int, int, int]]]:
    """Of each interval (apart or equal, if their prefix is), (bytes, rows, least, greatest value) between its probes, counted over all rows.

    A task adds up its own rows and returns at most a row for each probe.
    """
    # by prefix: the edges of all its intervals and probes in one sorted array, and what lies between each two
    edges: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    for prefix in dict.fromkeys(p for p, _, _ in intervals):
        marks: list[tuple[int, int]] = []
        for k, (own, low, high) in enumerate(intervals):
            if own == prefix:
                marks += [(x, k * PROBES + i) for i, x in enumerate([low, *probes(low, high)])] + ([(high + 1, -1)] if high < HIGHEST else [])
        # where one interval ends and the next begins, the beginning counts
        marks.sort(key=lambda m: (m[0], m[1]))
        edges[prefix] = np.array([x for x, _ in marks], np.int64), np.array([-1] + [n for _, n in marks], np.int64)
    schema = "place long, bytes long, n long, low long, high long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[int]] = {}
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in range(len(KEYS))]
            for prefix, (at, names) in edges.items():
                value, size = keys[len(prefix)], batch.column(len(KEYS)).to_numpy()
                for i, fixed in enumerate(prefix):
                    own = keys[i] == fixed if i == 0 else own & (keys[i] == fixed)
                if prefix:
                    value, size = value[own], size[own]
                order = np.argsort(value, kind="stable")
                value, size = value[order], size[order]
                place = names[np.searchsorted(at, value, "right")]
                starts = W.run_starts(place)
                if not len(starts):
                    continue
                sums, ends = np.add.reduceat(size, starts), np.append(starts[1:], len(place)) - 1
                for p, s, n, a, b in zip(place[starts].tolist(), sums.tolist(), (ends - starts + 1).tolist(), value[starts].tolist(), value[ends].tolist(), strict=True):
                    if p >= 0:
                        old = held.setdefault(p, [0, 0, a, b])
                        old[:] = old[0] + s, old[1] + n, min(old[2], a), max(old[3], b)
        found = [(p, *x) for p, x in held.items()]
        columns = list(zip(*found, strict=True)) if found else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["place", "bytes", "n", "low", "high"])

    total = rows.select(*KEYS, "_size").mapInArrow(count, schema).groupBy("place").agg(F.sum("bytes"), F.sum("n"), F.min("low"), F.max("high"))
    out: dict[tuple, list] = {i: [] for i in intervals}
    for place, *x in sorted(map(tuple, total.collect())):
        out[intervals[place // PROBES]].append(tuple(x))
    return out


def splitters(rows: DataFrame, shards: int, parts: int, tolerance: float = TOLERANCE) -> list[tuple[int, int, int]]:
    """The keys at which parts begin, without the first part, in order, for ``rows`` with the keys and ``_size``; ``parts`` make a shard."""
    everything = ((), LOWEST, HIGHEST)
    counts = histogram(rows, [everything])
    total = sum(x[0] for x in counts[everything])
    n = shards * parts
    wanted = [Wanted(total * i // n, (tolerance * parts if i % parts == 0 else ROUGH) * total / n) for i in range(1, n)]
    open_ = wanted
    while open_:
        for w in open_:
            w.narrow(counts[w.interval])
        open_ = [w for w in open_ if w.found is None]
        counts = histogram(rows, list(dict.fromkeys(w.interval for w in open_))) if open_ else {}
    # a rough border may lie beyond the next one, but none passes a shard's border
    cuts = list(itertools.accumulate((w.found for w in wanted), max))
    for i in range(n - 2, -1, -1):
        if (i + 1) % parts == 0:
            cuts[i] = wanted[i].found
        elif i + 1 < n - 1:
            cuts[i] = min(cuts[i], cuts[i + 1])
    return cuts


def part_of(cuts: list[tuple[int, int, int]]):
    """An Arrow-batched function of the keys: how many of the sorted ``cuts`` are not above them."""
    columns = [np.array([c[i] for c in cuts], np.int64) for i in range(len(KEYS))]

    @F.pandas_udf("int")
    def place(h: pd.Series, d: pd.Series, r: pd.Series) -> pd.Series:
        keys = [x.to_numpy() for x in (h, d, r)]
        out = np.zeros(len(h), np.int32)

        def go(level: int, rows: np.ndarray, low: int, high: int) -> None:
            """``rows`` share their first keys with the cuts from ``low`` to ``high``."""
            own, value = columns[level][low:high], keys[level][rows]
            left, right = low + np.searchsorted(own, value, "left"), low + np.searchsorted(own, value, "right")
            out[rows] = left
            if level == len(KEYS) - 1:
                out[rows] = right
                return
            for start in np.unique(left[left != right]).tolist():
                inside = (left == start) & (right != start)
                go(level + 1, rows[inside], start, int(right[inside][0]))

        go(0, np.arange(len(h)), 0, len(cuts))
        return pd.Series(out)

    return place


def sharded(docs: DataFrame, shards: int = SHARDS, parts: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` with ``size`` long, ``shard`` int and ``slot`` long: ranges of the key with nearly equal bytes, sorted and numbered.

    Needs doc_id and text; all other columns pass through the one exchange, and a column of a
    name that is added is replaced. ``size`` is the text's UTF-8 bytes and 8. A
    shard's border is off by ``tolerance`` of a mean shard at most, or by half a row where rows
    are larger; copies stay together where that allows. Null text has no bytes and is a group of its own, a null
    doc_id comes first in its group; repeated rows are rows like others. Fewer rows than shards leave
    shards empty, an empty table gives an empty result. ``parts`` is the number of tasks that write one shard.
    """
    spark = docs.sparkSession
    if shards < 1:
        raise ValueError("at least one shard")
    if parts is None:
        parts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    names = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    return _sorted(docs, {c: docs[f"`{c}`"] for c in names}, shards, parts, tolerance)


def _sorted(docs: DataFrame, columns: dict[str, Column], shards: int, parts: int | None, tolerance: float) -> DataFrame:
    """``columns`` of ``docs``, which has doc_id and text, and size, shard, slot."""
    spark = docs.sparkSession
    if shards < 1 or tolerance < 0:
        raise ValueError("at least one shard, and no negative tolerance")
    if parts is None:
        parts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    text = docs["text"].cast("string")
    scratch = Scratch(spark, "shards")
    keys = {"_h": F.xxhash64(text), "_d": F.coalesce(docs["doc_id"].cast("long"), F.lit(LOWEST)), "_r": F.monotonically_increasing_id(), "_size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES}
    # numbered as they are written, so that a row keeps its number; each count reads the keys alone
    rows = scratch.put(docs.select(F.struct(*(v.alias(k) for k, v in columns.items())).alias("row"), *(v.alias(k) for k, v in keys.items())), "rows")
    cuts = splitters(rows, shards, parts, tolerance)
    placed = rows.withColumn("_part", part_of(cuts)(*KEYS))
    counts = scratch.put(placed.groupBy("_part").agg(F.count("*").alias("n")), "counts")
    shard = F.floor(F.col("_part") / parts).cast("int")
    # a row for each part at most, and there are as many as tasks
    earlier = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col("_part").alias("of"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    exchanged = placed.repartitionById(shards * parts, F.col("_part")).sortWithinPartitions(*KEYS)
    # a partition is a part, and the lower bits number its rows
    in_part = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    numbered = exchanged.select("row", "_size", "_part", in_part.alias("_at"))
    return numbered.join(F.broadcast(first), F.col("_part") == F.col("of")).select(*(F.col(f"row.`{c}`").alias(c) for c in columns), F.col("_size").alias("size"), shard.alias("shard"), (F.col("first") + F.col("_at")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, parts: int | None = None) -> None:
    """Parquet files in a folder ``shard=<n>`` each, sorted as :func:`sharded` says; every task writes files of one shard."""
    sharded(docs, shards, parts).write.partitionBy("shard").parquet(path)


def report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document; see :func:`sharded`. Null text counts as empty in the checksum."""
    own = W.table(docs, "doc_id", "text")
    # the text's checks stand for it: what is written and exchanged is a few longs a row
    columns = {"doc_id": own["doc_id"].cast("long"), "text_crc32": F.crc32(F.coalesce(own["text"].cast("string"), F.lit("")))}
    out = _sorted(own, columns, shards, None, TOLERANCE)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Keyed state on streams against plain Python, over several micro-batches and restarts."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tamarisk.operators import splits
from tamarisk.streaming import moderation, rules_feed, stateful


class Feed:
    """A folder to which tables are added, read as a stream of one file a micro-batch."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, str(path), schema, 0

    def add(self, rows):
        df = rows if hasattr(rows, "schema") else self.spark.createDataFrame(rows, self.schema)
        df.coalesce(1).write.parquet(f"{self.path}/part={self.n}")
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(self.path)


@pytest.fixture
def feed(spark, tmp_path):
    return lambda schema: Feed(spark, tmp_path / "in", schema)


def until(done, seconds=40):
    end = time.time() + seconds
    while not done() and time.time() < end:
        time.sleep(0.2)
    assert done()


def test_batches_by_count_and_time(spark, feed, tmp_path):
    """Both triggers, order and no loss; batch numbers go on after a restart."""
    src = feed("page string, n long, note string")
    out = []

    def start():
        with stateful.state_store(spark):
            return stateful.batched(src.stream(), "page", "n").writeStream.foreachBatch(lambda b, e: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="100 milliseconds").start()

    rows = [("a", k, f"x{k}") for k in range(120)] + [(None, k, None) for k in range(7)]
    random.Random(1).shuffle(rows)
    src.add(rows)
    q = start()
    until(lambda: len(out) == 127)
    q.stop()
    own = sorted((r for r in out if r.page == "a"), key=lambda r: (r.batch, r.place))
    assert [(r.n, r.note) for r in own] == [(k, f"x{k}") for k in range(120)]
    assert Counter((r.batch, r.reason) for r in own) == {(0, "count"): 50, (1, "count"): 50, (2, "time"): 20}
    assert [(r.batch, r.reason, r.n, r.note) for r in sorted((r for r in out if r.page is None), key=lambda r: r.place)] == [(0, "time", k, None) for k in range(7)]
    out.clear()
    src.add([("a", 200, "late")])
    q = start()
    until(lambda: len(out) == 1)
    q.stop()
    assert (out[0].batch, out[0].place, out[0].reason, out[0].n) == (3, 0, "time", 200)


def test_waiting_rows_survive_a_restart(spark, feed, tmp_path):
    src = feed("page string, n long")
    got = []
    for first in (0, 30, 60):
        src.add([("a", k) for k in range(first, first + 30)])
        stateful.to_table(stateful.batched(src.stream(), "page", "n", 50, 3_600_000), str(tmp_path / "out"), str(tmp_path / "cp"))
        got.append(spark.read.schema("batch long, place int, reason string, page string, n long").parquet(str(tmp_path / "out")).collect())
    assert [len(x) for x in got] == [0, 50, 50]
    assert sorted(r.n for r in got[1]) == list(range(50)) and {r.reason for r in got[2]} == {"count"}


def test_lockouts_on_a_stream(spark, feed, tmp_path, data):
    """What the stream says over micro-batches and restarts is what the replay of all tries says."""
    events = spark.read.parquet(f"{data}/events.parquet")
    tries = events.select((F.col("user_id") % 7).alias("user_id"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 400).alias("at"), (F.col("event_type") == "signup").alias("success"))
    src = feed(tries.schema)
    whole = tries.orderBy("at", "event_id").collect()
    for k in range(4):
        src.add(spark.createDataFrame(whole[k * len(whole) // 4 : (k + 1) * len(whole) // 4], tries.schema))
        if k != 1:
            stateful.to_table(stateful.lockouts(src.stream()), str(tmp_path / "out"), str(tmp_path / "cp"))
    found = spark.read.parquet(str(tmp_path / "out"))
    expected = moderation.replay(tries)
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, expected.collect()))
    assert {r.outcome for r in found.select("outcome").distinct().collect()} == {"ok", "fail", "locked"}


def test_lockouts_expire(spark, feed, tmp_path):
    src = feed("user_id long, event_id long, at double, success boolean")
    for k in range(2):
        src.add([(1, k * 10 + j, float(k * 10 + j), False) for j in range(4)])
        stateful.to_table(stateful.lockouts(src.stream(), 500), str(tmp_path / "out"), str(tmp_path / "cp"))
        time.sleep(1)
    # eight failures would lock, were the first four not forgotten
    assert spark.read.parquet(str(tmp_path / "out")).where("locked_until > 0").count() == 0


def loader():
    """Made here, so that it is sent to the workers by value."""
    return lambda: lambda texts: [[("Toxic", len(t) % 10 / 10), ("Safe", 0.45)] for t in texts]


def brute_memo(rows, capacity):
    known, out = {}, []
    for key, seq, text in rows:
        mine = known.setdefault(key, {})  # in the order of coming in
        hit = text in mine
        if not hit:
            if len(mine) >= capacity:
                del mine[next(iter(mine))]
            bad = len(text) % 10 / 10
            mine[text] = ("TOXIC" if bad > 0.45 else "SAFE", bad)
        out.append((key, seq, text, *mine[text], hit))
    return out


@pytest.mark.parametrize("capacity", [1, 5, 500])
def test_memo(spark, feed, tmp_path, capacity):
    """Hits, evictions and answers are those of a queue, in one and in several micro-batches, after restarts."""
    rng = random.Random(capacity)
    rows = [(rng.choice("ab"), k, "t" * rng.randint(0, 12)) for k in range(300)]
    src = feed("page string, n long, text string")
    for k in range(3):
        part = rows[k * 100 : (k + 1) * 100]
        src.add(rng.sample(part, len(part)))
        stateful.to_table(stateful.remembered(src.stream(), "page", "n", loader(), capacity=capacity, batch=7), str(tmp_path / "out"), str(tmp_path / "cp"))
    found = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()
    assert [(r.key, r.seq, r.text, r.label, r.score, r.hit) for r in found] == brute_memo(rows, capacity)
    assert {r.error for r in found} == {None}


def test_memo_tells_failures(spark, feed, tmp_path):
    def failing():
        def call(texts):
            raise RuntimeError("down")

        return call

    src = feed("page string, n long, text string")
    src.add([("a", 0, "x"), ("a", 1, "x"), ("b", 2, None)])
    stateful.to_table(stateful.remembered(src.stream(), "page", "n", failing, retries=0), str(tmp_path / "out"), str(tmp_path / "cp"))
    found = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()
    assert [(r.label, r.error, r.hit) for r in found] == [(None, "down", False), (None, "down", True), (None, "down", False)]


@pytest.mark.parametrize("most", [1, 50])
def test_newest_on_a_stream(spark, feed, tmp_path, data, most):
    events = spark.read.parquet(f"{data}/events.parquet").select("event_id", (F.col("user_id") % 9).alias("user_id"), "event_type", "value")
    src = feed(events.schema)
    for k in range(3):
        src.add(events.where(f"event_id % 3 = {k}"))
    found = stateful.latest_to_table(stateful.newest(src.stream(), "user_id", most, "event_id"), str(tmp_path / "out"), str(tmp_path / "cp"), "user_id")
    expected = splits.newest(events, "user_id", most, "event_id")
    names = ["user_id", "rank", "event_id", "event_type", "value"]
    assert Counter(map(tuple, found.select(names).collect())) == Counter(map(tuple, expected.select(names).collect()))


def test_windows_on_a_stream(spark, feed, tmp_path):
    """Counts by hour over micro-batches; a row behind the watermark is left out."""
    src = feed("ts timestamp, kind string")
    at = lambda *minutes: spark.createDataFrame([(f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00", "a" if m % 2 else "b") for m in minutes], "t string, kind string").select(F.to_timestamp("t").alias("ts"), "kind")
    for rows in (at(5, 6, 65), at(7, 70, 200), at(210), at(9, 300)):
        src.add(rows)
    stateful.to_table(moderation.windowed(src.stream(), "kind").select(F.date_format("window.start", "HH").alias("hour"), "kind", "n"), str(tmp_path / "out"), str(tmp_path / "cp"))
    found = Counter({(r.hour, r.kind): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()})
    # appended once the watermark, ten minutes behind the newest row, has passed a window: minute 9 came too late
    assert found == {("00", "a"): 2, ("00", "b"): 1, ("01", "a"): 1, ("01", "b"): 1}


def test_added_blocks(spark, feed, tmp_path):
    """Three snapshots of a page emit each block once."""
    src = feed("page_id long, snapshot long, html string")
    shots = [["<p>one</p>", "<p>two</p>"], ["<p>one</p>", "<p>new <b>and bold</b></p>", "<p>two</p>"], ["<p>two</p>", "<p>last</p>", "<li>one</li>", "<p>last</p>"]]
    for k, parts in enumerate(shots):
        src.add([(7, k, "<div>" + "".join(parts) + "</div>"), (8, k, None), (9, k, "<p>always</p>")])
        stateful.to_table(stateful.added_blocks(src.stream()), str(tmp_path / "out"), str(tmp_path / "cp"))
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert Counter((r.page_id, r.snapshot, r.tag, r.text) for r in found) == Counter(
        [(7, 0, "p", "one"), (7, 0, "p", "two"), (7, 1, "p", "new and bold"), (7, 2, "p", "last"), (7, 2, "li", "one"), (9, 0, "p", "always")]
    )


def test_rules_that_change(spark, feed, tmp_path):
    """Each batch is judged by the newest version, a batch run again by its noted one, and a replay says the same."""
    rules, journal = str(tmp_path / "rules"), str(tmp_path / "journal")
    src = feed("doc_id long, text string")
    got = {}
    texts = ["an Idiot speaks", "a friend of a moron", "nothing", None]

    def run():
        q = rules_feed.moderate(src.stream(), rules, journal, lambda df, e: got.update({e: df.collect()}), str(tmp_path / "cp"), availableNow=True)
        q.awaitTermination()

    term = lambda *words: spark.createDataFrame([(w,) for w in words], "term string")
    src.add([(k, t) for k, t in enumerate(texts)])
    run()
    rules_feed.publish(term("idiot"), rules)
    src.add([(10 + k, t) for k, t in enumerate(texts)])
    run()
    assert rules_feed.publish(term("moron", "friend"), rules) == 2
    src.add([(20 + k, t) for k, t in enumerate(texts)])
    run()
    assert {e: {(r.doc_id % 10, r.version, r.culprit) for r in rows if r.is_toxic} for e, rows in got.items()} == {0: set(), 1: {(0, 1, "idiot")}, 2: {(1, 2, "friend")}}
    assert all(len(rows) == 4 for rows in got.values())
    # the second batch once more, although there is a newer version
    assert rules_feed.version_of(spark, rules, journal, 1) == 1
    every = spark.createDataFrame([(e * 10 + k, t, e) for e in range(3) for k, t in enumerate(texts)], "doc_id long, text string, epoch int")
    again = rules_feed.replay(every, rules, journal)
    assert Counter(map(tuple, again.collect())) == Counter(tuple(r) for rows in got.values() for r in rows)

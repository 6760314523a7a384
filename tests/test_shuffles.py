"""What is made of a text may be many times its size: only what tells the pieces apart is shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from tamarisk.operators import rules as R
from tamarisk.operators import suite as G
from tamarisk.streaming import stateful


def shuffled(spark, group, run):
    """Bytes that the jobs of a call write for a shuffle."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    store, tracker = sc._jsc.sc().statusStore(), sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return out, sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)


@pytest.fixture(scope="module")
def random_texts():
    rng = random.Random(3)
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789 ", k=20_000)) for _ in range(12)]


def test_hard_negatives_shuffle_no_cases(spark, random_texts):
    df = spark.createDataFrame([("a", t) for t in random_texts], "category string, text string").repartition(3).localCheckpoint()
    out, n = shuffled(spark, "negatives", lambda: G.hard_negatives(df, ["{}", "he said {}"]).select(F.sha2("text", 256)).collect())
    assert len(out) == len(set(out)) == 8 * len(random_texts)
    assert n < 2 * sum(map(len, random_texts))


def test_hard_negatives_of_equal_cases(spark):
    """Least category and flags over equal texts of other categories, frames and disguises; null stays one case."""
    rows = [("b", "x y"), ("a", "x y"), ("c", "he said x y"), (None, "x y"), ("b", "z"), ("c", None), ("c", "")]
    frames = {"a": ["{}", "he said {}"], "b": ["he said {}"]}
    expected = {}
    for category, t in rows:
        made = [(f.replace("{}", t) if t is not None else None, ["framed"]) for f in frames.get(category, [])]
        signs = {"dots": ".", "spaces": " ", "tatweel": "ـ", "diacritics": "َ", "zero_width": "​"}
        made += [(None if t is None else s.join(t), ["disguised", n]) for n, s in signs.items()]
        made.append((None if t is None else t[:1] * 4 + t[1:], ["disguised", "elongate"]))
        for text, flags in made:
            old = expected.get(text)
            least = category if old is None or old[0] is None else old[0] if category is None else min(category, old[0])
            expected[text] = (least, flags if old is None else min(flags, old[1]))
    out = G.hard_negatives(spark.createDataFrame(rows, "category string, text string"), frames).collect()
    assert {r.text: (r.category, r.flags) for r in out} == expected and len(out) == len(expected) and {r.expected for r in out} == {0}


def test_sentence_candidates_shuffle_no_texts(spark, random_texts):
    df = spark.createDataFrame([(i, ["غىىىبي", *t.split(" ")]) for i, t in enumerate(random_texts)], "doc_id long, tokens array<string>").repartition(3).localCheckpoint()
    out, n = shuffled(spark, "candidates", lambda: R.sentence_candidates(df).select("doc_id", "place", F.xxhash64("candidate").alias("h")).collect())
    assert len(out) == 40 * len(random_texts) == len({r.h for r in out})
    assert n < sum(map(len, random_texts)) / 2


def test_sentence_candidates_of_shared_keys(spark):
    """Rows of one key are one text's: each candidate once, ranked together; null is a key."""
    one, two = ["abc", "def"], ["xyz"]
    rows = [(1, one), (1, one), (2, one), (None, two), (None, one), (3, ["ab cd", "cd"]), (4, None)]
    expected = set()
    for key in (1, 2, None, 3):
        ranked = {}
        for k, tokens in rows:
            if k == key:
                for i, w in enumerate(tokens):
                    for j, c in enumerate(R.repairs(w) if len(w) >= 3 else []):
                        text = " ".join([*tokens[:i], c, *tokens[i + 1 :]])
                        ranked[text] = min(ranked.get(text, (i, j)), (i, j))
        # the first of each key; ties between rows of a key are open
        expected |= {(key, rank) for rank in sorted(ranked.values())[:4]}
    out = R.sentence_candidates(spark.createDataFrame(rows, "doc_id long, tokens array<string>")).collect()
    assert sorted((str(r.doc_id), r.place) for r in out) == sorted((str(k), p) for k in (1, 2, None, 3) for p in (1, 2, 3, 4))
    own = [r.candidate for r in sorted((r for r in out if r.doc_id == 2), key=lambda r: r.place)]
    assert own == [" ".join([c, "def"]) for c in R.repairs("abc")[:4]]
    assert own == [r.candidate for r in sorted((r for r in out if r.doc_id == 1), key=lambda r: r.place)]


def test_full_requests_come_many_at_once():
    """A frame and a look at the state for many requests, not for each."""

    class State:
        def __init__(self):
            self.value, self.calls = None, 0

        def exists(self):
            return self.value is not None

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

        put = update

        def clear(self):
            self.value = None

    class Handle:
        listTimers = staticmethod(lambda: [])
        registerTimer = staticmethod(lambda at: None)

    class Clock:
        getCurrentProcessingTimeInMs = staticmethod(lambda: 0)

    import pandas as pd

    b = stateful.Batches(50)
    b.handle, b.waiting, b.flushed = Handle(), State(), State()
    rows = pd.DataFrame({"key": "k", "seq": range(30_020), "payload": [str(i) for i in range(30_020)]}).sample(frac=1, random_state=1)
    frames = list(b.handleInputRows(("k",), iter([rows.iloc[:9000], rows.iloc[9000:]]), Clock()))
    more = list(b.handleInputRows(("k",), iter([pd.DataFrame({"key": "k", "seq": range(40_000, 40_040), "payload": "x"})]), Clock()))
    out = pd.concat(frames + more)
    assert len(frames) == 3 and b.flushed.calls < 6
    assert out.seq.tolist() == [*range(30_020), *range(40_000, 40_030)]
    assert (out.batch * 50 + out.place).tolist() == list(range(30_050))
    assert b.flushed.value == (601,) and [s for s, _ in b.waiting.value] == list(range(40_030, 40_040))

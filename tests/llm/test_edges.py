"""Rows and columns that the other tests lack: repeats, null ids, very long texts, clashing names in the stages, short lines."""

import hashlib
import itertools
import random
from collections import Counter

import public_tokenizers
import pytest

WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
PROSE = "the committee met again in spring to talk about the cost of the old bridge over the river because nobody had paid for it since winter and people in town wanted to know who would work on it".split()


def prose(rng, n):
    return " ".join(rng.choice(PROSE) for _ in range(n))


def test_quality_of_repeated_rows(spark):
    from tamarisk.llm import quality

    text = prose(random.Random(1), 90)
    rows = [(1, text, "en"), (1, text, "en"), (1, None, "en"), (1, None, None), (None, text, "en"), (None, text, "en"), (2, prose(random.Random(2), 40_000), "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = Counter(tuple(r) for r in quality.measure(df, PIECES, WORD_BPE).collect())
    assert sorted(found.values()) == [1, 2, 2, 2]
    assert max(r[1] for r in found) == 40_000
    assert quality.keep_good(df, PIECES, WORD_BPE).count() == sum(n for r, n in found.items() if r[7])


def test_very_long_urls(spark):
    from tamarisk.llm import urls

    tail = "x" * 300_000
    rows = [(1, f"https://a.example.org/es/{tail}"), (2, f"https://{'sub.' * 5000}net/de/?{tail}"), (3, f"https://b.test/{tail}-porn-{tail}"), (4, f"https://b.test/{tail}porn{tail}"), (5, tail), (6, None), (6, None)]
    found = {(r.page_id, r.verdict, r.rule): r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert set(found) == {(1, "block", "org/es/"), (2, "allow", "net/de/"), (3, "block", None), (4, "allow", None), (5, "allow", None), (6, "allow", None)}
    assert len(found[1, "block", "org/es/"].path) == len(tail) + 4


def test_fingerprints_of_null_ids(spark):
    """Null ids come first; every row has one result, and repeated rows follow each other."""
    from tamarisk.llm import fingerprints

    rng = random.Random(3)
    rows = [(None, prose(rng, 30)), (None, prose(rng, 40)), (3, prose(rng, 50)), (3, prose(rng, 20)), (7, prose(rng, 60)), (7, None)]
    rows += [rows[2]] * 2
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    expected = Counter()
    for (i, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        t, following = t or "", following or ""
        half = len(t) // 2
        expected[i, len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()] += 1
    found = fingerprints.near_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == expected


def test_stages_with_clashing_columns_and_long_texts(spark):
    """Columns named like those that the operators use pass through; a very long text stays whole."""
    import corpus_pipeline

    rng = random.Random(4)
    long = "\n".join(prose(rng, 25) for _ in range(3000))
    rows = [(k, "\n".join(prose(rng, 25) for _ in range(5)), "en", "s", 1, "row", f"c{k}", 2.5, [k]) for k in range(12)] + [(50, long, None, None, None, None, "c50", None, None), (None, None, None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, gone string, bucket double, id array<int>"
    df = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.columns == df.columns and out.schema["id"].dataType == df.schema["id"].dataType
        kept = {r.doc_id: r for r in out.collect()}
        # the quality rules may reject some; every other stage keeps all of these
        assert kept.keys() >= ({*range(12), 50} if name != "quality_rules" else set())
        for k in kept.keys() & set(range(12)):
            assert (kept[k].row, kept[k].gone, kept[k].bucket, kept[k].id) == ("row", f"c{k}", 2.5, [k]), name
        if 50 in kept:
            assert len(kept[50].text) > 0.9 * len(long) and kept[50].gone == "c50"
    assert corpus_pipeline.STAGES[-1][1](spark, df, "").count() > 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("steps", [((6, 1), (20, 2)), ((4, 1),), ((9, 2), (30, 3))])
def test_short_lines_by_parameter(spark, steps):
    """Near copies of lines shorter than the default's least are found where the steps begin lower."""
    from tamarisk.llm import lines

    rng = random.Random(str(steps))
    base = ["".join(rng.choice("abc ") for _ in range(n)) for n in range(3, 34) for _ in range(2)]

    def edited(s):
        at = rng.randrange(len(s))
        return rng.choice((s[:at] + "z" + s[at:], s[:at] + s[at + 1 :], s[:at] + "b" + s[at + 1 :]))

    texts = base + [edited(b) for b in base] + [edited(edited(b)) for b in base]
    rng.shuffle(texts)
    rows = [(k, "\n".join(texts[k * 6 : k * 6 + 6])) for k in range(31)]
    items = [(i, p, x) for i, t in rows for p, x in enumerate(t.split("\n"))]
    most = lambda n: max((e for low, e in steps if n >= low), default=0)
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(items)), 2):
        s, t = items[a][2], items[b][2]
        k = most(min(len(s), len(t)))
        if k and abs(len(s) - len(t)) <= k and distance(s, t) <= k:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    gone = {items[x][:2] for x in range(len(items)) if find(x) != x}
    found = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), steps, steps[0][0]).collect()}
    assert found == {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in rows}
    assert len(gone) > 20

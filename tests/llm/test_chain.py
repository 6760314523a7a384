"""The filter audit, sharding and the manifest against brute force on small, awkward tables."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join(rng.choice(("alpha", "Beta", "GAMMA", "delta,", "eps", "100%", "eta.", "über")) + str(rng.randint(0, 60)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, lang, source, n_chars): nulls in every column, empty texts, copies over sources, a hot source, repeated rows, one very long text."""
    rng = random.Random(21)
    texts = [None, "", " \n ", "one", "#", prose(rng, 30_000), "x " * 500] + [prose(rng, rng.randint(1, 400)) for _ in range(25)]
    out = []
    for i in range(150):
        source = "hot" if i % 3 == 0 else rng.choice((None, "", "a", "a b", "ä", "z" * 40, "A"))
        text = rng.choice(texts)
        out.append((i * 7 % 1000, None if text is None else text + ("\nline\n" if i % 4 == 0 else ""), rng.choice((None, "en", "")), source, rng.choice((None, 5))))
    out += out[10:14] + [out[10]] * 5
    out += [(None, "no id", "en", "a", 1), (None, "no id", "en", "a", 1), (None, None, None, None, None), (5, "other text, same id", "en", "hot", 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names clash with those the operators use."""
    wide = [(*r, k, "p", "m") for k, r in enumerate(rows)]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, shard long, part string, leaf string").repartition(5)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(7, 1, 0, 9), (7, 0, 1, 9), (14, None, 1, 9), (0, 1, None, 9), (None, 1, 1, 9), (777_777, 1, 1, 9), (21, 1, 1, 9), (28, 0, 0, 9), (35, 1, 0, 9)], "doc_id long, quality int, toxic int, mask int")


def test_audit(docs, rows, labels):
    from tamarisk.llm import audit

    firsts = {}
    for i, t, *_ in rows:
        if i is not None:
            firsts[t or ""] = min(i, firsts.get(t or "", i))
    good, toxic = {7, 0, 21, 35}, {7, 14, 21}
    failed = defaultdict(list)
    for i, t, _, source, _ in rows:
        words, t = WORDS.findall(t or ""), t or ""
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > firsts[t],
        }
        failed[source or ""].append(({k for k, v in fails.items() if v}, i in good, i in toxic))
    expected, removed_in = {}, Counter()
    for part, own in failed.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                here = [x for x in own if f in x[0] and not x[0] & set(order[: step - 1])]
                removed_in[part, f] += len(here)
                expected[part, order, step] = (
                    sum(not x[0] & set(order[:step]) for x in own), len(here), sum(f in x[0] for x in own) - len(here),
                    sum(x[0] == {f} for x in own), sum(x[1] for x in here), sum(x[2] for x in here),
                )
    found = audit.audit(docs, labels).collect()
    assert len(found) == len(expected) == 600 * len(failed)
    for r in found:
        assert tuple(r)[3:9] == expected[r.part, r.filter_order, r.step]
        assert r.shapley == removed_in[r.part, r.filter_order[r.step - 1]]


def test_audit_of_nothing(docs, labels):
    from tamarisk.llm import audit

    assert audit.audit(docs.where("false"), labels).count() == 0
    assert {r.good_lost for r in audit.audit(docs, labels.where("false")).select("good_lost").distinct().collect()} == {0}


def test_parity_sums_invert(spark):
    """The signed sums are those of the definition, and the inverse gives back the masks."""
    from tamarisk.llm import audit

    rng = random.Random(4)
    masks = [(rng.choice("ab"), rng.randrange(32), rng.random() < 0.3, rng.random() < 0.3) for _ in range(500)]
    sums = audit.parity_sums(spark.createDataFrame(masks, "part string, mask int, good boolean, toxic boolean"))
    for r in sums.collect():
        own = [m for p, m, g, t in masks if (p, g, t) == (r.part, r.good, r.toxic)]
        assert list(r.sums) == [sum((-1) ** (m & s).bit_count() for m in own) for s in range(32)]
    for r in audit.cells(sums).collect():
        own = [m for m in masks if m[0] == r.part]
        assert list(r.n) == [sum(m[1] == k for m in own) for k in range(32)]
        assert list(r.n_toxic) == [sum(m[1] == k and m[3] for m in own) for k in range(32)]


def sizes_of(rows):
    return [len((t or "").encode()) + 8 for _, t, *_ in rows]


def by_shard(found):
    out = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.shard, r.slot)):
        out[r.shard].append(r)
    return out


@pytest.mark.parametrize("parts", [1, 3])
def test_shards(spark, docs, rows, parts):
    from tamarisk.llm import shards

    found = shards.sharded(docs.where("doc_id IS NULL OR length(coalesce(text, '')) < 50000"), 6, parts, 0.01).collect()
    kept = [r for r in rows if r[0] is None or len(r[1] or "") < 50_000]
    assert Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in found) == Counter(kept)
    assert all(r.size == len((r.text or "").encode()) + 8 and r.part == "p" for r in found)
    every, mean = by_shard(found), sum(sizes_of(kept)) / 6
    largest = max(sizes_of(kept))
    for own in every.values():
        assert [r.slot for r in own] == list(range(len(own)))
        assert abs(sum(r.size for r in own) - mean) <= 0.02 * mean + largest
    # one order over all shards, and copies next to each other
    order = [r.text for s in sorted(every) for r in every[s]]
    assert len(list(itertools.groupby(order))) == len(set(order))


def test_shards_nearest_borders(spark):
    """Without tolerance each border is the nearest one in the key's order, also inside a group of copies and inside repeated rows."""
    from tamarisk.llm import shards

    rng = random.Random(5)
    texts = ["hot" * 5] * 60 + ["again" * 3] * 50 + [("t" * rng.randint(0, 60)) + str(k) for k in range(60)]
    data = [(k if t != "again" * 3 else 1, t) for k, t in enumerate(texts)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    keyed = sorted((r.h, r.doc_id, len(r.text) + 8) for r in df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect())
    ends = [0, *itertools.accumulate(k[2] for k in keyed)]
    borders = [min(range(len(ends)), key=lambda i, c=c: (abs(ends[i] - ends[-1] * c // 7), i)) for c in range(1, 7)]
    expected = [b - a for a, b in itertools.pairwise([0, *borders, len(keyed)])]
    for parts in (1, 4):
        found = by_shard(shards.sharded(df, 7, parts, 0.0).collect())
        assert [len(found[s]) for s in range(7)] == expected


def test_shards_of_little(spark, docs):
    from tamarisk.llm import shards

    assert shards.report(docs.where("false")).count() == 0
    one = shards.report(docs.where("doc_id = 14")).collect()
    assert sorted((r.shard, r.slot) for r in one) == sorted(set((r.shard, r.slot) for r in one))
    same = spark.createDataFrame([(1, "x")] * 48, "doc_id long, text string")
    assert Counter(r.shard for r in shards.report(same).collect()) == {s: 2 for s in range(24)}
    assert Counter(r.shard for r in shards.report(spark.createDataFrame([(None, None)] * 24, "doc_id long, text string")).collect()) == {s: 1 for s in range(24)}


def test_shard_report(docs, rows):
    from tamarisk.llm import shards

    found = shards.report(docs).collect()
    assert found[0].asDict().keys() == {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert {r.law for r in found} == {"bytes"} and {r.grown_shard for r in found} == {None}
    for own in by_shard(found).values():
        assert [r.slot for r in own] == list(range(len(own)))


def test_written_shards(spark, docs, tmp_path):
    from tamarisk.llm import shards

    shards.write_shards(docs.drop("shard"), str(tmp_path / "out"), 4, 2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() <= 4
    assert max(len(list(d.glob("*.parquet"))) for d in (tmp_path / "out").glob("shard=*")) <= 2


def test_growing_tables_move_borders_not_laws(spark):
    """The splitters of the same keys do not depend on how the rows are partitioned."""
    from tamarisk.llm import shards

    df = spark.createDataFrame([(k, "t" * (k % 50)) for k in range(300)], "doc_id long, text string")
    a = {(r.doc_id, r.shard, r.slot) for r in shards.report(df.repartition(2)).collect()}
    assert a == {(r.doc_id, r.shard, r.slot) for r in shards.report(df.repartition(7)).collect()}


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (row[0], row[3], row[2], row[4], row[1])))


def climb(nodes):
    """(root, for each node the siblings (left, right) by level)"""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for path, j in zip(paths, at, strict=True):
            q = j // 3 * 3
            path.append((level[q:j], level[j + 1 : q + 3]))
        at, level = [j // 3 for j in at], [H(*level[q : q + 3]) for q in range(0, len(level), 3)]
    return level[0], paths


def brute_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0] is not None, r[0], leaf(r), r))
    keys = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in keys:
        groups[s].sort(key=lambda x: (x[0], x[1] or 0, x[2]))
        trees[s] = climb([x[2] for x in groups[s]])
    root, tops = climb([trees[s][0] for s in keys])
    out = Counter()
    for s, over in zip(keys, tops, strict=True):
        for (_, i, own, row), path in zip(groups[s], trees[s][1], strict=True):
            node = own
            if i is not None and zlib.crc32(str(i).encode()) % 2 == 0 and row[1] is not None:
                node = leaf((row[0], row[1].replace("\n", ""), *row[2:]))
            for left, right in path + over:
                node = H(*left, node, *right)
            proof = H(*(x for left, right in path + over for x in left + right))
            out[i, own, trees[s][0], root, proof, node, node == root] += 1
    return out


def manifest_rows(df):
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


@pytest.mark.parametrize("partitions", [1, 4, 23])
def test_manifest(spark, docs, rows, partitions):
    """With as many partitions as put a group into one, into a few, and runs of a level onto both sides of many borders."""
    from tamarisk.llm import manifest

    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        found = manifest_rows(manifest.manifest(docs))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert found == brute_manifest(rows)
    assert {v for *_, v in found} == {True, False}


def test_manifest_of_little(spark, docs):
    from tamarisk.llm import manifest

    assert manifest.manifest(docs.where("false")).count() == 0
    row = (3, "a\nb", None, "s", None)
    df = spark.createDataFrame([row], "doc_id long, text string, lang string, source string, n_chars long")
    assert manifest_rows(manifest.manifest(df)) == brute_manifest([row])
    assert manifest.manifest(df).first().proof_sha256 == H()
    many = [(k, "t", "en", f"s{k:04d}", k) for k in range(200)]
    assert manifest_rows(manifest.manifest(spark.createDataFrame(many, df.schema).repartition(3))) == brute_manifest(many)


def test_manifest_proofs(docs):
    """The proof that is returned leads from the leaf to the root, and from no other leaf."""
    from tamarisk.llm import manifest

    for r in manifest.manifest(docs, None, with_siblings=True).limit(60).collect():
        node, other = r.leaf, H("other")
        for left, right in zip(r.lefts, r.rights, strict=True):
            node, other = H(left, node, right), H(left, other, right)
        assert node == r.root == r.folded_root and r.verified and other != r.root
        assert H(*(x for pair in zip(r.lefts, r.rights, strict=True) for x in pair)) == r.proof_sha256


def test_pieces_make_complete_subtrees():
    """Cut anywhere, the own nodes and the ragged ones cover each leaf once."""
    from tamarisk.llm.manifest import Piece

    for start, n, total in [(0, 5, 20), (1, 30, 100), (2, 1, 9), (9, 18, 27), (7, 40, 47), (0, 27, 28), (26, 2, 28)]:
        piece = Piece(start, total, [str(i).encode() for i in range(start, start + n)])
        covered = sorted(x for k, j, _ in piece.ragged() for x in range(j * 3**k, (j + 1) * 3**k))
        assert covered == list(range(start, start + n))
        assert len(list(piece.ragged())) <= 4 * (2 + math.ceil(math.log(n + 1, 3)))

"""Each operator against brute force on small, awkward tables."""

import hashlib
import itertools
import random
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

WORDS = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def prose(rng, n):
    return " ".join(rng.choice(("alpha", "Beta", "gamma", "delta,", "eps", "zeta", "eta.", "über")) + str(rng.randint(0, 30)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Nulls, empties, blanks, copies, near copies, shared passages, one long text."""
    rng = random.Random(3)
    base = [prose(rng, rng.randint(3, 200)) for _ in range(12)]
    passage = prose(rng, 70)
    out = [None, "", "  \n ", "one", "two words\nand a line that is long enough", prose(rng, 4000)]
    for b in base:
        out += [b, b] if rng.random() < 0.5 else [b]
        words = b.split()
        words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
        if rng.random() < 0.6:
            out.append(prose(rng, 20) + "\n" + passage + "\n" + prose(rng, 15))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    """With columns whose names clash with those the operators use."""
    rows = [(i * 3, t, "en", "s", "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, bucket string, n int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def of(texts):
    return {i * 3: t or "" for i, t in enumerate(texts)}


def test_packing(docs, empty, texts):
    from tokenizers import Tokenizer

    from tamarisk.llm import packing

    library = Tokenizer.from_file(WORD_BPE)
    rows = packing.pack(docs, WORD_BPE, capacity=64, block_tokens=4096, with_ids=True).collect()
    parts, sequences = {}, {}
    for r in rows:
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids)) == r.ids_crc32
        parts.setdefault(r.doc_id, []).append((r.start, list(r.ids), r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in of(texts).items():
        own = sorted(parts[i])
        assert list(itertools.chain.from_iterable(x for _, x, _ in own)) == library.encode(t, add_special_tokens=False).ids + [1]
        assert all(n == sum(len(x) for _, x, _ in own) for _, _, n in own)
    for s in sequences.values():
        s.sort()
        ends = list(itertools.accumulate(n for _, n in s))
        assert [o for o, _ in s] == [0, *ends[:-1]]
        assert ends[-1] <= 64 and ends[-1] & (ends[-1] - 1) == 0
    assert packing.pack(empty, WORD_BPE).count() == 0


def test_pack_is_by_cost():
    import numpy as np

    from tamarisk.llm.packing import assign

    placed = assign(np.array([3, 8, 5, 4]), np.array([10, 10]))
    assert placed == [(1, 0, 8, 0), (2, 0, 5, 1), (3, 0, 4, 1), (0, 0, 2, 0), (0, 2, 1, 1)]


def test_pieces(docs, empty, texts):
    import sentencepiece

    from tamarisk.llm import sentencepieces as sp

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoded = sp.encode(docs, PIECES)
    rows = by_id(encoded)
    for i, t in of(texts).items():
        assert list(rows[i].ids) == library.encode(t) and rows[i].round_trip
    back = by_id(sp.decode(encoded, PIECES))
    assert all(back[i].text == t for i, t in of(texts).items())
    assert sp.encode(empty, PIECES).count() == 0


def test_pieces_of_awkward_texts(spark):
    """Segments on both sides of the longest, long texts, the space's own sign, control characters, repeated rows, null ids."""
    import sentencepiece

    from tamarisk.llm import sentencepieces as sp

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(14)
    rows = [(n, "".join(rng.choice("abcdeé☃") for _ in range(n))) for n in range(60, 70)]
    rows += [(100, "a▁b"), (101, "\t\x00x\n\n y"), (102, "word " * 30000), (103, "z" * 20000), (None, "same"), (104, "same"), (104, "same"), (105, None), (106, "  two  spaces  ")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int")
    found = sp.encode(df, PIECES).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, tuple(r.ids)) for r in found) == sorted((-1 if i is None else i, tuple(library.encode(t or ""))) for i, t in rows)
    assert {r.doc_id for r in found if not r.round_trip} == {100}
    assert all(zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r.ids)) == r.ids_crc32 and r.n_ids == len(r.ids) for r in found)
    back = {r.doc_id: r.text for r in sp.decode(sp.encode(df.where("doc_id IS NOT NULL"), PIECES), PIECES).collect()}
    assert all(back[i] == (t or "") for i, t in rows if i not in (None, 100))


def test_viterbi_is_best():
    from tamarisk.llm import sentencepieces as sp

    model = sp.pieces(PIECES)
    score = {t: model.score[i] for i, t in enumerate(model.text) if not model.is_byte[i] and i > 2}
    segments = ["▁hello", "▁the", "▁weiß", "▁日本", "▁xyzzy☃", "x" * 90, "▁▁▁a", "\n"]
    _, _, best = model.viterbi(segments)
    for s, found in zip(segments, best, strict=True):
        table = [0.0] + [float("-inf")] * len(s)
        for j in range(1, len(s) + 1):
            for k in range(1, min(j, 16) + 1):
                piece = s[j - k : j]
                value = score.get(piece, model.unknown_score if k == 1 else float("-inf"))
                table[j] = max(table[j], table[j - k] + value)
        assert found == pytest.approx(table[-1])


def near_groups(texts):
    sets = {}
    for i, t in of(texts).items():
        w = re.findall(WORDS, t.translate(LOWER))
        sets[i] = set(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_minhash(docs, empty, texts):
    from tamarisk.llm import minhash

    rows = by_id(minhash.near_duplicates(docs))
    assert {i: (r.n_shingles, r.component_id) for i, r in rows.items()} == near_groups(texts)
    assert all(r.kept == (i == r.component_id) for i, r in rows.items())
    assert minhash.near_duplicates(empty).count() == 0


def test_minhash_of_unlike_copies(spark):
    """Copies of one text, many of them linked with no other, of a group without a centre, and chains; resemblances around the threshold."""
    from tamarisk.llm import minhash

    rng = random.Random(12)
    rows = []
    for g in range(3):
        base = [f"g{g}w{rng.randint(0, 400)}" for _ in range(90)]
        chain = list(base)
        for k in range(40):
            own = list(base if k % 3 else chain)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 30)}"
            chain = chain if k % 3 else own
            rows.append((len(rows) * 7, " ".join(own)))
    rng.shuffle(rows)
    found = by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert {i: r.component_id for i, r in found.items()} == {i: find(i) for i in sets}
    sizes = [sum(find(i) == r for i in sets) for r in set(map(find, sets))]
    assert max(sizes) > 10 and sizes.count(1) > 10


def test_minhash_recall():
    """Bands propose every pair at the threshold or over it, of a thousand generated ones."""
    import numpy as np

    from tamarisk.llm import minhash

    rng = np.random.default_rng(2)
    missed = 0
    for n in (30, 150, 900):
        for _ in range(350):
            common = -(-6 * n // 7)
            x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            y = np.concatenate([x[:common], rng.integers(0, 1 << 63, n - common, dtype=np.uint64)])
            both = np.concatenate([x, y, x[:1]])
            keys = minhash.band_keys(*minhash.signatures(both, np.array([0, n, 2 * n, 2 * n + 1])))
            missed += not (keys[0] == keys[1]).any()
    assert missed <= 1


def test_parity_maps_bound_differences():
    import numpy as np

    from tamarisk.llm import minhash

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, n, dtype=np.uint64)) for n in (1, 5, 80, 200, 0, 900)]
    maps = minhash.parity_maps(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
    for (x, p), (y, q) in itertools.combinations(zip(sets, maps, strict=True), 2):
        assert np.bitwise_count(p ^ q).sum() <= len(np.setxor1d(x, y))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_banded_distance(spark, edits):
    from tamarisk.llm.lines import trimmed, within

    rng = random.Random(edits)
    pairs = [("", ""), ("a", ""), ("", "ab")]
    for _ in range(300):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 12)))
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(("", "a", "é"))
        pairs.append((a, "".join(b)))
    chars = lambda c: F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(c, ""))
    df = spark.createDataFrame(pairs, "x string, y string")
    cut = F.exists(trimmed(F.col("x"), F.col("y")), lambda s: within(chars(s.x), chars(s.y), edits))
    for r in df.select("x", "y", cut.alias("near")).collect():
        assert r.near == (distance(r.x, r.y) <= edits), (r.x, r.y)


def test_lines(spark, empty):
    from tamarisk.llm import lines

    rng = random.Random(8)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randint(15, 40))) for _ in range(10)]

    def changed(s):
        at = rng.randrange(len(s))
        return rng.choice((s, s[:at] + "x" + s[at:], s[:at] + s[at + 1 :], s[: at // 2] + "yy" + s[at:]))

    rows = [(i, None if i == 7 else "\n".join(changed(rng.choice(base)) for _ in range(rng.randint(0, 5))), "k") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed string")
    items = [(i, p, x) for i, t, _ in rows if t is not None for p, x in enumerate(t.split("\n")) if len(x) >= lines.SHORTEST]
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(items)), 2):
        if abs(len(items[a][2]) - len(items[b][2])) <= 1 and distance(items[a][2], items[b][2]) <= 1:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    gone = {items[x][:2] for x in range(len(items)) if find(x) != x}
    out = by_id(lines.dedup_lines(df))
    for i, t, _ in rows:
        assert out[i].text == (None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone))
        assert out[i].removed == "k"
    assert lines.dedup_lines(empty).count() == 0


def near_lines(items, most):
    """(document, place) of all but the first of each component, by all pairs."""
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(items)), 2):
        s, t = items[a][2], items[b][2]
        if s == t or (k := most(min(len(s), len(t)))) and abs(len(s) - len(t)) <= k and distance(s, t) <= k:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {items[x][:2] for x in range(len(items)) if find(x) != x}


def test_lines_by_length(spark):
    """Threshold by length as registered: at each number of edits up to one more than it, over the steps' borders."""
    from tamarisk.llm import lines

    rng = random.Random(9)

    def edited(s, n):
        for _ in range(n):
            at = rng.randrange(len(s))
            s = rng.choice((s[:at] + "é" + s[at:], s[:at] + s[at + 1 :], s[:at] + "z" + s[at + 1 :]))
        return s

    texts = []
    for n in (21, 30, 38, 40, 42, 58, 61, 79, 80, 83, 120, 122, 300):
        base = "".join(rng.choice("abcd ") for _ in range(n))
        texts += [base] + [edited(base, k) for k in (1, 2, 3, 4, 5, 5)]
    rng.shuffle(texts)
    rows = [(i, "\n".join(texts[i * 7 : i * 7 + 7])) for i in range(13)]
    items = [(i, p, x) for i, t in rows for p, x in enumerate(t.split("\n")) if len(x) >= 20]
    gone = near_lines(items, lambda n: min(n // 20, 4))
    found = by_id(lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), lines.BY_LENGTH))
    for i, t in rows:
        assert found[i].text == "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone)


def test_line_conditions_are_necessary(spark):
    """What the join tests before the distance holds for every pair within the edits, whichever letters they touch."""
    from tamarisk.llm import lines

    assert len(set(lines.LETTERS)) == len(lines.LETTERS)
    rng = random.Random(12)
    alphabet = lines.LETTERS + "zq é"
    pairs = []
    for c in alphabet:
        for n in (20, 39, 40, 41, 60, 79, 80, 120):
            base = "".join(rng.choice(alphabet) for _ in range(n))
            most = min(n // 20, 4)
            other = list(base)
            for _ in range(most):
                at = rng.randrange(len(other) + 1)
                other[at : at + rng.choice((0, 1))] = rng.choice(([], [c], [c]))
            pairs += [(base, "".join(other))] + [(base, base[:k] + c * e + base[k:]) for k in (0, n // 2, n) for e in range(1, most + 1)]
    df = spark.createDataFrame(pairs, "x string, y string")
    for edits in (lines.BY_LENGTH, 1, 3):
        allowed = (lambda n: min(n // 20, 4)) if edits is lines.BY_LENGTH else (lambda n, e=edits: e)
        f = lambda c: F.struct(lines.counted(F.col(c), F.length(c)).alias("counts"), F.col(c).alias("line")).alias(f"f_{c}")
        rows = df.select("x", "y", f("x"), f("y")).select("x", "y", lines.may_be_near("f_x", "f_y", edits).alias("may"), lines.not_far("f_x", "f_y", edits).alias("close")).collect()
        seen = 0
        for r in rows:
            if distance(r.x, r.y) <= allowed(min(len(r.x), len(r.y))):
                seen += 1
                assert r.may and r.close, (r.x, r.y)
        assert seen > 100


def test_line_counts_stay_compiled(spark):
    """The JVM only interprets methods over 8000 bytes; a condition that each pair of a bucket meets must not make one."""
    import re

    from tamarisk.llm import lines

    assert all((a ^ b).bit_count() == 1 for a, b in zip(lines.RING, lines.RING[1:] + lines.RING[:1], strict=True))
    df = spark.createDataFrame([(1, "a line of some letters")], "bucket long, line string")
    side = lambda c: df.select("bucket", F.struct(lines.counted(F.col("line"), F.length("line")).alias("counts")).alias(c)).localCheckpoint()
    x, y = side("x"), side("y")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        met = x.join(y.hint("merge"), (x.bucket == y.bucket) & lines.may_be_near("x", "y", lines.BY_LENGTH)).groupBy(x.bucket).count()
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", spark._jvm.PythonSQLUtils.explainString(met._jdf.queryExecution(), "codegen"))]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) < 8000, sizes


def test_lines_are_cut_alike_as_bytes_and_characters(spark):
    """The parts of a line don't depend on whether another character of it takes two bytes."""
    from tamarisk.llm import lines

    rng = random.Random(14)
    texts = ["".join(rng.choice("abcd  ") for _ in range(n)) for n in (20, 39, 64, 100, 301)]
    rows = [(i, x[:-1] + last, len(x)) for i, x in enumerate(texts) for last in ("z", "é")]
    found = {(r.i, r.line[-1]): r.buckets for r in lines.named(spark.createDataFrame(rows, "i long, line string, n int"), lines.BY_LENGTH).where("own").collect()}
    for i in range(len(texts)):
        # the first segment lies at the start, so it never holds the last character
        assert found[i, "z"][0] is not None and found[i, "z"][0] == found[i, "é"][0]


def test_line_queries_use_the_threshold(spark, tmp_path):
    """A changed short word, three edits, is found by the query and the stage."""
    import corpus_pipeline
    from tamarisk.llm import queries

    line = "the committee met again in spring to talk about the %s of the old bridge over the river"
    df = spark.createDataFrame([(1, line % "cost", "en", "s", 0), (2, line % "rest", "en", "s", 0), (3, line % "removal", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_near for r in queries.op4_lines(spark, str(tmp_path)).collect()} == {1: 0, 2: 1, 3: 0}
    assert {r.doc_id: r.text == "" for r in corpus_pipeline.line_dedup(spark, df, "").collect()} == {1: False, 2: True, 3: False}


def test_short_lines(spark, tmp_path):
    """Equal lines of any length go from query and stage if they hold a word; near ones under 20 code points stay."""
    import corpus_pipeline
    from tamarisk.llm import queries

    rows = [(1, "Home\n\nshort line\n--"), (2, "Home\n\nshort lines\n--\nغبي\nx"), (3, "غبي\n7\nHome\n7")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {1: "Home\n\nshort line\n--", 2: "\nshort lines\n--\nغبي\nx", 3: "7"}
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, df, "").collect()} == kept
    out = by_id(queries.op4_lines(spark, str(tmp_path)))
    assert {i: (r.n_removed, r.n_near, r.kept_sha256) for i, r in out.items()} == {i: (n, 0, hashlib.sha256(kept[i].encode()).hexdigest()) for i, n in ((1, 0), (2, 1), (3, 3))}


def test_lines_reject_five_edits(spark):
    from tamarisk.llm import lines

    for edits in (5, ((20, 1), (100, 5))):
        with pytest.raises(ValueError, match="at most 4 edits"):
            lines.dedup_lines(spark.createDataFrame([(1, "a")], "doc_id long, text string"), edits)
    with pytest.raises(ValueError, match="at most 4 edits"):
        lines.within(F.col("a"), F.col("b"), 5)


def test_quality_counts(docs, empty, texts):
    from tamarisk.llm import quality

    rows = by_id(quality.measure(docs, PIECES, WORD_BPE))
    for i, t in of(texts).items():
        w = re.findall(WORDS, t)
        windows = list(zip(w, w[1:], w[2:], strict=False))
        covered = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)} if len(w) < 500 else None
        seen, repeated = set(), 0
        for line in t.split("\n"):
            if re.search(WORDS, line):
                repeated += line in seen
                seen.add(line)
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), repeated)
        if covered is not None:
            assert r.n_repeat_words == len(covered)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in quality.keep_good(docs, PIECES, WORD_BPE).collect()}
    assert kept == {i for i, r in rows.items() if r.kept}
    assert quality.measure(empty, PIECES, WORD_BPE).count() == 0


def test_quality_verdict(spark, texts):
    """Every measure and the verdict against the libraries and the definition, in known and unknown languages and scripts."""
    import math
    from collections import Counter

    import sentencepiece
    from tokenizers import Tokenizer

    from tamarisk.llm import quality

    pieces, words_ = sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(WORD_BPE)
    rng = random.Random(21)
    arabic, symbols = "سلام كلام كتاب بيت نهر جبل باب شمس قمر ليل".split(), "☃ 漢 字 語 ☂ ♞".split()
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    rows += [(200 + k, " ".join(rng.choice(PLAIN) for _ in range(n)), lang) for k, (n, lang) in enumerate([(60, "en"), (400, "en"), (3000, "en"), (60, "xx"), (60, None), (400, "de")])]
    rows += [(300, " ".join(rng.choice(arabic) for _ in range(90)), "ar"), (301, " ".join(rng.choice(symbols) for _ in range(90)), "zz"), (302, "x" * 70 + " " + " ".join(rng.choice(PLAIN) for _ in range(80)), "en"), (303, "x y z " * 30, "en"), (None, None, None)]
    found = [r for r in quality.measure(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES, WORD_BPE).collect()]
    by = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    for i, t, lang in rows:
        own = re.findall(WORDS, t or "")
        ids = [x for w in own for x in pieces.encode(w)]
        others = sum(len(words_.encode(w, add_special_tokens=False).ids) for w in own)
        r = by[i]
        assert r.n_tokens == len(ids)
        chars = sum(map(len, own))
        assert r.chars_per_token == pytest.approx(chars / max(1, len(ids))) and r.chars_per_token_2 == pytest.approx(chars / max(1, others))
        assert r.byte_share == pytest.approx(sum(pieces.is_byte(x) for x in ids) / max(1, len(ids)))
        size = min(50, len(ids))
        if size < 2:
            assert r.entropy == 1
        else:
            places = [min(k * size, len(ids) - size) for k in range(-(-len(ids) // size))]
            each = [-sum(n / size * math.log2(n / size) for n in Counter(ids[p : p + size]).values()) / math.log2(size) for p in places]
            assert r.entropy == pytest.approx(sum(each) / len(each))
        letters = Counter("latin" if ord(c) < 0x250 else "arabic" if 0x600 <= ord(c) < 0x780 else "other" for c in t or "" if c.isalpha())
        name = lang if lang in quality.BANDS else max(("latin", "arabic", "other"), key=lambda k: letters[k])
        one, two, most, least = quality.BANDS[name]
        slack = quality.SLACK / max(1, len(ids)) ** 0.5
        within = one[0] - slack <= r.chars_per_token <= one[1] and two[0] - slack <= r.chars_per_token_2 <= two[1] and r.byte_share <= most and r.entropy >= least
        assert r.kept == (not r.base_failed and within), (i, name)
    assert by[201].kept and by[202].kept and not by[303].kept and abs(by[200].entropy - by[202].entropy) < 0.05


def test_fingerprints(docs, empty, texts):
    from tamarisk.llm import fingerprints

    rows = by_id(fingerprints.near_edits(docs))
    all_ = of(texts)
    ids = sorted(all_)

    def shingles(t):
        w = re.findall(WORDS, t)
        return set(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else ({tuple(w)} if w else set())

    def likeness(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    for k, i in enumerate(ids):
        t, following = all_[i], all_[ids[(k + 1) % len(ids)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = rows[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        exact = len(shingles(t) | shingles(edited)) <= 128
        assert r.near_edited == pytest.approx(likeness(shingles(t), shingles(edited)), abs=1e-9 if exact else 0.2)
        assert r.near_next == pytest.approx(likeness(shingles(t), shingles(following)), abs=0.2)
    prints = {}
    assert all(prints.setdefault(all_[i], r.fingerprint) == r.fingerprint for i, r in rows.items())
    assert fingerprints.near_edits(empty).count() == 0
    alone = fingerprints.near_edits(docs.where("doc_id = 9")).first()
    assert alone.near_next == 1.0


def test_sketches_merge(spark):
    from tamarisk.llm import fingerprints as fp

    parts = spark.createDataFrame([("k", "a b c d e f g h"), ("k", "c d e f g h i j k"), ("l", "x y")], "key string, text string")
    rows = {r.key: r.s for r in fp.merge_groups(parts.select("key", fp.sketch(F.col("text")).alias("s")), "key", "s").collect()}
    whole = spark.createDataFrame([("a b c d e f g h i j k",)], "text string").select(fp.sketch(F.col("text")).alias("s")).first().s
    assert rows["k"] == whole and len(rows["l"]) == 1


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("mail john [at] example [dot] com now", [("email", "john [at] example [dot] com")]),
        ("john at example dot com", [("email", "john at example dot com")]),
        ("jоhn@exаmple.com", [("email", "jоhn@exаmple.com")]),
        ("call plus one five five five two two three four four five", [("phone", "plus one five five five two two three four four five")]),
        ("４１１１ １１１１ １１１１ １１１１", [("card", "４１１１ １１１１ １１１１ １１１１")]),
        ("look at me. dot dot dot", []),
        ("meet at noon at example.com", []),
    ],
)
def test_disguised(text, kinds):
    import pyarrow as pa

    from tamarisk.llm.pii import batch_spans

    _, base, both = batch_spans(pa.array([text]))[0]
    assert base == [] and [(k, text[s:e]) for s, k, e in both] == kinds


def test_suspect_holds_where_texts_are_rewritten():
    """Nothing is found by the transducers that the prefilter hides."""
    import pyarrow as pa

    from tamarisk.llm.pii import batch_spans, spans

    rng = random.Random(6)
    parts = ["john", "smith@example.com", "example", "com", "dot", "Punkt", "point", " at ", "[at]", "(dot)", "{.}", "@", " @ ", "%40", "&#64;", "one", "two", "five", "4111", "+", ".", "-", "plus", "a", "AT", "<at>", "chez", "\n", "1", "@x.", "(", ")", "[ @ ]", "\xa0", "\x0b", "\x1c", "\x85", "é"]
    texts = ["mail john dot smith@example.com now", "a@b\tdot com x"]
    texts += ["".join(rng.choice(parts) + rng.choice(("", " ", " ", "  ")) for _ in range(rng.randint(2, 14))) for _ in range(20000)]
    for text, base, both in batch_spans(pa.array(texts)):
        assert (base, both) == spans(text, True), text
    text, _, both = batch_spans(pa.array(texts[:1]))[0]
    assert [text[s:e] for s, _, e in both] == ["john dot smith@example.com", "smith@example.com"]


def test_pii_base(spark, empty):
    from tamarisk.llm import pii

    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("a@.1 +-2(5x%") for _ in range(rng.randint(0, 60)))) for i in range(3000)] + [(3000, None), (3001, "9" * 3000 + " 1.2.3.256 1.2.3.4 4111 1111 1111 1111 +1 (555) 123-4567 a.b@c.d.e")]
    out = by_id(pii.detect(spark.createDataFrame(rows, "doc_id long, text string")))
    for i, t in rows:
        found, t = [], t or ""
        for k, (kind, p) in enumerate((("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
            for m in re.finditer(p, t):
                digits = re.sub("[^0-9]", "", m[0])
                if (kind == "email") or (kind == "ip" and all(int(x) < 256 for x in m[0].split("."))) or (kind == "card" and 12 <= len(digits) <= 19 and pii.luhn(digits)) or (kind == "phone" and 9 <= len(digits) <= 15):
                    found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
        text = ",".join(x for _, _, x in sorted(found))
        assert out[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert out[i].n_email == sum(k == 0 for _, k, _ in found)
    assert pii.detect(empty).count() == 0
    red = spark.createDataFrame([(1, "to a@b.cc or 1.2.3.4", 5), (2, None, 6)], "doc_id long, text string, z int")
    assert [tuple(r) for r in pii.redacted(red).orderBy("doc_id").collect()] == [(1, "to <email> or <ip>", 5), (2, None, 6)]


@pytest.mark.parametrize("hot", [2048, 1])
def test_substrings(docs, empty, texts, hot):
    from tamarisk.llm import substrings

    words = {i: re.findall(WORDS, t) for i, t in of(texts).items()}
    first = {}
    for i, w in words.items():
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), i)
    rows = by_id(substrings.remove_repeats(docs, hot=hot))
    removed = 0
    for i, w in words.items():
        gone = {j for s in range(len(w) - 49) if first[tuple(w[s : s + 50])] < i for j in range(s, s + 50)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        removed += len(gone)
        assert (rows[i].n_words, rows[i].n_removed, rows[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert removed > 500
    assert substrings.remove_repeats(empty).count() == 0


def test_automaton():
    from tamarisk.llm.substrings import SuffixAutomaton

    rng = random.Random(1)
    rows = [(d, [rng.randint(0, 2) for _ in range(rng.randint(1, 30))]) for d in range(12)]
    a = SuffixAutomaton()
    for d, w in rows:
        a.add(w, d)
    a.close()
    for _, w in rows:
        expected = [min(d for d, x in rows if any(x[j : j + 5] == w[s : s + 5] for j in range(len(x) - 4))) for s in range(len(w) - 4)]
        assert a.first_documents(w, 5) == expected
    assert set(a.first_documents([9] * 8, 5)) == {1 << 63}


def test_urls(spark):
    import duckdb
    import pandas as pd

    from tamarisk.llm import urls

    rows = ["https://A.Example.com/en/7?x#y", "http://example.com/en/8", "ftp://x.net/de/1", "https://www.example.net/de/8x", "https://q.org/es/", "https://b.example/xxx/a", "https://b.example/axxx/", "https://b/free-win-bet", "https://b/free-win", "no scheme porn", None, "", "http://notexample.com:80?a=://b", "http://com/en/", "x://é.org/es/\nz"]
    rows += ["https://b/poker-poker", "https://b/poker.win", "https://b/free-cheap", "https://b/free-cheap-deal", "https://b/deal.com/free", ""] + ["https://b/" + "x-" * 30000 + "poker-casino"]
    pages = pd.DataFrame({"page_id": range(len(rows)), "url": rows})
    names = ["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft", "soft_weight"]
    mine = urls.judge(spark.createDataFrame(list(zip(range(len(rows)), rows, strict=True)), "page_id long, url string")).orderBy("page_id").select(*names).collect()
    con = duckdb.connect()
    con.register("pages", pages)
    assert [tuple(r) for r in mine] == con.sql(f"SELECT {', '.join(names)} FROM ({urls.oracle_sql()}) ORDER BY page_id").fetchall()
    assert [r.verdict for r in mine[15:21]] == ["allow", "block", "allow", "block", "allow", "allow"] and mine[-1].verdict == "block"
    empty_pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(empty_pages).count() == 0
    twice = urls.judge(spark.createDataFrame([(1, "https://b/xxx", "h")] * 2 + [(None, None, "h")], "page_id long, url string, host string")).collect()
    assert sorted((r.page_id or 0, r.verdict) for r in twice) == [(0, "allow"), (1, "block"), (1, "block")]
    assert [r.verdict for r in mine[:9]] == ["allow", "block", "allow", "block", "block", "block", "allow", "block", "allow"]


def test_language_model(docs, empty, texts):
    import math
    from collections import Counter, defaultdict

    from tamarisk.llm import ngrams

    rows = by_id(ngrams.perplexity(docs))
    tokens = {i: re.findall(WORDS, t.translate(LOWER)) + ["\n"] for i, t in of(texts).items()}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for i in train for w in tokens[i])
    n, v = sum(c.values()), len(c)
    two = Counter(p for i in train for p in zip(["\0", *tokens[i][:-1]], tokens[i], strict=True))
    of_counts = Counter(two.values())
    d = ngrams.discounts([of_counts[k] for k in (1, 2, 3, 4)])
    follow, precede, total = defaultdict(lambda: [0, 0, 0]), Counter(), Counter()
    for (a, b), k in two.items():
        follow[a][min(k, 3) - 1] += 1
        precede[b] += 1
        total[a] += k
    low = Counter(precede.values())
    d0 = ngrams.discounts([low[k] for k in (1, 2, 3, 4)])
    gamma0 = sum(d0[min(k, 3)] * m for k, m in low.items()) / len(two)
    q = lambda w: max(precede[w] - d0[min(precede[w], 3)], 0) / len(two) + gamma0 / (v + 1)

    def p(a, b):
        if a not in total:
            return q(b)
        k = two.get((a, b), 0)
        return (max(k - d[min(k, 3)], 0) + sum(x * y for x, y in zip(d[1:], follow[a], strict=True)) * q(b)) / total[a]

    assert sum(p("alpha1", w) for w in c) + p("alpha1", "unheard") == pytest.approx(1)
    for i, own in tokens.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(own), sum(c[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
        assert r.score == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(["\0", *own[:-1]], own, strict=True)))
    assert ngrams.perplexity(empty).count() == 0


def test_null_ids_and_repeated_rows(spark):
    from tamarisk.llm import minhash, ngrams, packing, substrings

    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (2, text), (2, None)], "doc_id long, text string")
    near = minhash.near_duplicates(df).collect()
    assert sorted((r.doc_id, r.component_id) for r in near if r.doc_id) == [(1, 1), (1, 1), (2, 1), (2, 2)]
    assert [r.kept for r in near if r.doc_id is None] == [True]
    import corpus_pipeline

    other = text.replace("w", "v")
    rows = [(1, text), (2, text), (2, other), (3, other + " end"), (3, text + " end"), (1, None)]
    own = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id, r.text or "") for r in corpus_pipeline.near_dedup(spark, own, "").collect()) == [(1, ""), (1, text), (2, other)]
    gone = sorted((r.doc_id or 0, r.n_removed) for r in substrings.remove_repeats(df).collect())
    assert gone == [(0, 0), (1, 0), (1, 0), (2, 0), (2, 80)]
    assert packing.pack(df, WORD_BPE).agg(F.count_distinct("sequence_id", "offset")).first()[0] == packing.pack(df, WORD_BPE).count()
    assert ngrams.perplexity(df).count() == 5


PLAIN = (
    "the committee met again in spring to talk about the cost of the old bridge over the river because nobody had paid for it since winter and people in town wanted to know who would work on it next year "
    "while others said that a new road is better for all of them after lunch every child drew maps with green hills small boats tall towers and some horses near water under bright clouds before evening came "
    "music played from open windows as farmers sold apples bread honey cheese fish salt wool candles paper books lamps chairs ropes"
).split()


def test_pipeline(spark):
    """Every stage on prose, with copies, repeated lines, personal data, nulls, repeated rows and a null id."""
    import corpus_pipeline

    rng = random.Random(5)
    rows = []
    for i in range(30):
        rows.append((i, "\n".join(" ".join(rng.choice(PLAIN) for _ in range(18)) for _ in range(6)) + f"\nwrite to me{i}@example.com"))
    rows += [(30, rows[3][1] + " now"), (31, None), (32, ""), (33, "too short"), (34, "buy buy buy " * 40), (None, rows[5][1] + " then"), (4, rows[4][1]), (35, rows[6][1].replace("\n", " "))]
    own = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, own, "")
        assert out.columns == own.columns
        own = spark.createDataFrame(out.collect(), own.schema)
        assert own.where("n_chars != length(text)").count() == 0
        kept.append(sorted(-1 if r.doc_id is None else r.doc_id for r in own.collect()))
    assert set(range(30)) <= set(kept[0]) and not {31, 32, 33, 34} & set(kept[0])
    texts_ = " ".join(r.text for r in own.collect())
    assert "<email>" in texts_ and "@example.com" not in texts_
    assert set(range(30)) - {4} <= set(kept[-1])
    assert corpus_pipeline.STAGES[-1][1](spark, own, "").count() > 0
    empty = own.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_nulls_repeats_and_long_texts(spark):
    """op4, op6, op7: null ids, repeated rows, one doc_id with two texts, clashing columns, a very long text."""
    from tamarisk.llm import fingerprints, lines, pii

    long = "\n".join(f"line number {i} of a very long text with mail me{i % 7}@example.com in it" for i in range(3000))
    rows = [(None, "a line that is long enough to count\nsecond"), (1, "a line that is long enough to count\nsecond"), (1, "a line that is long enough to count\nsecond"), (1, "another text"), (2, None), (3, ""), (4, long), (5, "\n".join(long.split("\n")[:1500]))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, gone string, bucket int")
    out = lines.dedup_lines(df, lines.BY_LENGTH, exact=True).collect()
    assert len(out) == len(rows) and all(r.gone == "x" and r.bucket == 1 for r in out)
    assert [r.text for r in out if r.doc_id == 1 and r.n_lines == 2] == ["", ""]
    assert [r.n_removed for r in out if r.doc_id is None] == [0] and [r.text for r in out if r.doc_id == 2] == [None]
    whole = {r.doc_id: r for r in out if r.doc_id in (4, 5)}
    assert whole[5].text == "" and whole[4].n_lines == 3000 and whole[4].text.startswith("line number 0 of")
    found = pii.detect(df).collect()
    assert len(found) == len(rows) and {r.doc_id: r.n_email for r in found}[4] == 3000
    assert sorted(r.n_email for r in found) == [0] * 6 + [1500, 3000]
    prints = fingerprints.near_edits(df.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()
    assert len(prints) == 5 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in prints)


def test_disguises_that_the_pattern_holds():
    """Whatever the at pattern matches is rewritten, whether or not anything else in the text is disguised."""
    from tamarisk.llm import pii

    for text in ("jean (chez) example.com", "hans [klammeraffe] example.de", "john ( at) example.com", "a {AT } b.org", "x [at] y.net", "ann &#64; z.com", "bob%40z.com", "carl [\u00a0at] q.org"):
        for whole in (text, f"to the point: {text}", f"{text} and no dot"):
            assert pii.AT.search(whole)
            assert [k for _, k, _ in pii.spans(whole)[1]] == ["email"], whole
            assert re.search(pii.SUSPECT.replace("\\x{85}", "\\x85").replace("\\x{A0}", "\\xa0").replace("\\x{0}", "\\x00").replace("\\x{FF}", "\\xff").replace("\\x{AD}", "\\xad"), whole)
    assert pii.spans("meet at noon (at the point)")[1] == []


def test_lost_arrays_raise(spark, docs, monkeypatch):
    """A file that is not there, or not whole, is an error and not an empty array."""
    from tamarisk.llm import ngrams

    real = ngrams.save
    for lost in (".count", ".key"):
        monkeypatch.setattr(ngrams, "save", lambda path, array, lost=lost: real(path, array[:-1] if path.endswith(lost) else array))
        with pytest.raises(Exception, match="values of|No such file|cannot mmap"):
            ngrams.perplexity(docs).collect()
    with pytest.raises(FileNotFoundError):
        ngrams.load("/nowhere/at/all", "int64", 1)
    assert len(ngrams.load("/nowhere/at/all", "int64", 0)) == 0


def test_batch_rows_only_shrink(spark):
    from tamarisk.llm import words

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    try:
        for before, after in (("10000", "500"), ("0", "500"), ("7", "7")):
            spark.conf.set(key, before)
            words.small_batches(spark)
            assert spark.conf.get(key) == after
    finally:
        spark.conf.set(key, old)

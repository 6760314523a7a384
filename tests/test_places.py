"""The layers look at the texts' tokens in the tasks, as the column expressions have it."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tamarisk.functions import text as T
from tamarisk.operators import lexicon as L
from tamarisk.operators import rules as R

ODD = ["غبي", "غغبي", "غ.ب.ي", "حمارة", "يا", "ىى", "كىىىلب", "aىb", "ى", "س،،ل", "a..b", "x ىy", "m\x85ى", "🐶", "۰ۃہ", "--", "س-", " "]


def texts(n=200):
    rng = random.Random(3)
    return [rng.choice((" ", "  ", "\n", "\t ")).join(rng.choice(ODD) for _ in range(rng.randint(0, 6))) for _ in range(n)] + [None, "", " "]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("arrays", [True, False])
@pytest.mark.parametrize("most", [0, 100_000])
def test_places(spark, monkeypatch, arrays, most):
    """Vocabulary and places of texts or arrays, with hits sent to the tasks or joined."""
    monkeypatch.setattr(L, "BROADCAST_ROWS", most)
    monkeypatch.setattr(L, "HELD_TOKENS", 5)
    docs = spark.createDataFrame(list(enumerate(texts())), "`an id` long, text string").withColumnRenamed("an id", "id")
    listed = docs.select("id", T.tokens(F.col("text")).alias("tokens"))
    own, name = (listed, "tokens") if arrays else (docs, "text")
    words = {r.token for r in listed.select(F.explode("tokens").alias("token")).collect()}
    got = [r.token for r in L.vocabulary(own, name).collect()]
    assert set(got) == words and len(got) == len(words)
    hits = spark.createDataFrame([("غبي", 1), ("غبي", 2), ("--", 1), ("nowhere", 1)], "token string, shape int")
    want = listed.select("id", F.inline(L.placed(F.col("tokens")))).join(hits, "token")
    columns = ["id", "i", "token", "before2", "before", "after", "alone", "shape"]
    found = L.places(own, "id", name, hits).select(columns)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.select(columns).collect()))


def test_shapes(spark):
    rows = spark.createDataFrame([(t,) for t in texts()], "t string").select("t", F.array(*(f(F.col("t")) for f in L.SHAPES)).alias("s")).collect()
    assert all(r.t is None or L.shapes(r.t) == r.s for r in rows)


def test_any_evades(spark):
    """A text evades if one of its tokens does."""
    df = spark.createDataFrame([(t,) for t in texts()], "t string")
    rows = df.select("t", R.any_evades(F.col("t")).alias("a"), F.coalesce(F.exists(T.tokens(F.col("t")), R.evades), F.lit(False)).alias("b"), T.tokens(F.col("t")).alias("w"), F.transform(T.tokens(F.col("t")), R.evades).alias("e")).collect()
    assert all(r.a == r.b for r in rows) and {r.a for r in rows} == {True, False}
    assert all([R.EVASIVE.search(w) is not None for w in r.w or ()] == (r.e or []) for r in rows)


def test_runtime_profile_is_its_steps(spark):
    """The runtime profile in one pass is the chain of its steps."""
    rng = random.Random(4)
    pool = "ابأٱ  ىةهـًٰ\t\x1c\x85  ​́oaRTusſU@_.-9٣۵😀ﷺﬁ가\x00"
    odd = [None, "", *("".join(rng.choice([*pool, "http://x ", "www.y", " RT ", "user ", "uſer", "@ab", " ا ب "]) for _ in range(rng.randint(1, 14))) for _ in range(1500))]
    t = T.drop_zero_width(T.nfkc(T.fold_homoglyphs(F.col("t"))))
    t = T.drop_placeholders(T.drop_mentions(T.drop_links(t), unicode_words=False), ("USER", "URL"), unicode_words=False)
    t = T.stitch(T.only_arabic(t, blank=True), both_lone=True)
    steps = F.coalesce(T.collapse_spaces(T.cap_repeats(T.letters(t))), F.lit(""))
    df = spark.createDataFrame([(x,) for x in odd], "t string")
    for r in df.select("t", T.normalize(F.col("t"), "runtime").alias("a"), steps.alias("b")).collect():
        assert r.a == r.b, ascii(r.t)
    # fails without the single pass: each step was a pattern over the whole text
    assert "regexp_replace" not in plan(df.select(T.normalize(F.col("t"), "runtime")))


def test_verdict_explodes_no_text(spark, monkeypatch):
    """No layer makes a row of each token of the texts: the hits are looked up where the text lies."""
    seen = []
    places = L.places
    monkeypatch.setattr(L, "places", lambda *a: seen.append(places(*a)) or seen[-1])
    docs = spark.createDataFrame([(1, "انت غبي"), (2, "يا غىىىبي"), (3, "كلام طيب")], "doc_id long, text string")
    out = {r.doc_id: r.layer for r in R.verdict(docs, spark.createDataFrame([("غبي", "exact", "word")], "term string, tier string, kind string")).collect()}
    assert out == {1: "dict", 2: "resolver", 3: "-"}
    assert len(seen) == 2 and all(re.search("MapInArrow", plan(d)) and "Generate" not in plan(d) for d in seen)


def test_model_candidates_are_the_first(spark):
    """Only the first k are made; they are the first of all, also of rows that share a key."""
    docs = spark.createDataFrame([(1, ["كىىىلب", "وحماىىىر"]), (2, ["abcd"]), (3, ["غىىىبي", "x y z"]), (4, ["يا", "كىىىم"]), (4, ["يا", "كىىىم"]), (None, ["ىى"]), (5, None), (6, ["ىىى"])], "doc_id long, tokens array<string>")
    for k in (0, 1, 3, 4, 7):
        want = R.sentence_candidates(docs.where(F.exists("tokens", R.evades))).where(F.col("place") <= k)
        assert sorted(map(repr, R.model_candidates(docs, k=k).collect())) == sorted(map(repr, want.collect()))


def test_emoji_of_long_signs(spark):
    """Each sign of the three kinds, and its like that is none of them."""
    for chars, flag in ((R.TOXIC_EMOJI, "toxic_emoji"), (R.THREAT_EMOJI, "threat_emoji"), (R.ANIMAL_EMOJI, "undirected_animal")):
        rows = spark.createDataFrame([(f"a {c} b",) for c in chars], "t string").select(R.emoji(F.col("t")).alias("e")).collect()
        assert [r.e.flags for r in rows] == [[flag]] * len(chars)
        assert all(c.encode().startswith(R.EMOJI_BYTES) for c in chars)
    e = spark.createDataFrame([("😀 x",), (None,)], "t string").select(R.emoji(F.col("t")).alias("e")).collect()
    assert [(r.e.is_toxic, r.e.score, r.e.flags, r.e.extracted) for r in e] == [(False, 0.0, [], "")] * 2


@pytest.mark.parametrize("many_forms", [True, False])
def test_few_terms_are_found_as_many(spark, monkeypatch, many_forms):
    """Few phrases and parts are sought where the texts lie, without a hash of each window; both ways find the same."""
    terms = [("غبي يا", "phrase"), ("حمارة", "phrase"), ("س ", "phrase"), ("", "phrase"), (None, "phrase"), ("ىب", "partial"), ("x", "partial"), ("..", "partial"), ("غغ", "partial"), ("ۃہ", "partial"), ("غبي", "word")]
    lexicon = spark.createDataFrame([(t, "exact", k) for t, k in terms], "term string, tier string, kind string")
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts())], "doc_id long, text string")
    called = []
    whole = L.contained
    monkeypatch.setattr(L, "contained", lambda *a: called.append(1) or whole(*a))
    few = {tuple(r) for r in L.inside(docs, lexicon, "doc_id", "text", many_forms, ("غغ",)).collect()}
    assert not called
    monkeypatch.setattr(L, "FEW_TERMS", 0)
    assert few == {tuple(r) for r in L.inside(docs, lexicon, "doc_id", "text", many_forms, ("غغ",)).collect()} and called
    assert {k for _, k in few} == {"phrase", "partial"} and len(few) < 101


def test_long_shapes(spark):
    """A long text is squeezed as array, as the expressions have it."""
    long = [" ".join(t for t in texts() if t)[:n] + "ااا😀😀" for n in (40, 60, 500)]
    rows = spark.createDataFrame([(t,) for t in long], "t string").select("t", F.array(*(f(F.col("t")) for f in L.SHAPES)).alias("s")).collect()
    assert all(L.shapes(r.t) == r.s for r in rows)


def test_gate(spark):
    cases = ["a b c", " a b c", "a b", " a b ", "abc", "", None, "a\nb\tc", "a  b  c  d e f", " \n a b"]
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", R.gate(F.col("t")).alias("g")).collect()
    assert all(r.g == (r.t is not None and len(r.t) >= 3 and len(r.t.split()) >= 3) for r in rows)

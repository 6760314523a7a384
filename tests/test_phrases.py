"""Phrases and parts by hash join against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tamarisk.functions import text as T
from tamarisk.operators import lexicon as L
from tamarisk.operators import phrases
from tamarisk.operators import rules as R


def brute(texts, needles):
    by_length = defaultdict(dict)
    for variant, term, needle in needles:
        if needle:
            by_length[len(needle)].setdefault((variant, needle), set()).add(term)
    out = {}
    for key, variant, text in texts:
        for n, own in by_length.items():
            for at in range(len(text or "") - n + 1):
                for term in own.get((variant, text[at : at + n]), ()):
                    first, count = out.get((key, variant, term), (at, 0))
                    out[key, variant, term] = min(first, at), count + 1
    return out


def found(df):
    return {(r.doc_id, r.variant, r.term): (r.first, r.n) for r in df.collect()}


def frames(spark, texts, needles):
    return spark.createDataFrame(texts, "doc_id long, variant int, text string").repartition(3), spark.createDataFrame(needles, "variant int, term string, needle string")


def test_matches(spark):
    rng = random.Random(2)
    alphabet = "ab é😀 "
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    texts = [(k, k % 2, word(rng.randint(0, 120))) for k in range(60)] + [(60, 0, None), (61, 0, ""), (62, 0, "a" * 5000)]
    needles = [(rng.randrange(2), f"t{k}", word(rng.randint(0, 9))) for k in range(300)] + [(0, "long", texts[0][2]), (0, "none", None), (0, "run", "a" * 37), (0, "run", "aa"), (1, "whole", texts[1][2][:17])]
    assert found(phrases.matches(*frames(spark, texts, needles))) == brute(texts, needles)


def test_a_hundred_thousand_phrases(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [(k, 0, line(rng.randint(1, 300))) for k in range(80)]
    terms = list(dict.fromkeys(line(rng.randint(2, 4)) for _ in range(120_000)))[:100_000]
    assert len(terms) == 100_000
    needles = [(0, t, t) for t in terms]
    assert found(phrases.matches(*frames(spark, texts, needles))) == brute(texts, needles)


def test_nothing(spark):
    texts, needles = frames(spark, [(1, 0, "abc")], [(0, "b", "b")])
    assert phrases.matches(texts.where("false"), needles).count() == 0
    assert phrases.matches(texts, needles.where("false")).count() == 0


def test_contained(spark):
    lexicon = spark.createDataFrame([("in the", "exact", "phrase"), ("قلة ادب", "exact", "phrase"), ("x", "exact", "partial"), ("ing", "exact", "partial"), ("own", "exact", "partial"), ("word", "exact", "word")], "term string, tier string, kind string")
    docs = spark.createDataFrame([(1, "begin there"), (2, "قله ادب"), (3, "x word"), (4, "thing of my own"), (5, None)], "doc_id long, text string")
    assert {tuple(r) for r in L.contained(docs, lexicon, allowed=("own",)).collect()} == {(1, "phrase", "in the"), (2, "phrase", "قلة ادب"), (4, "partial", "ing")}


@pytest.mark.parametrize("many_forms", [True, False])
def test_verdict_by_phrases(spark, many_forms):
    """The verdict takes phrases and parts of any number; a phrase is named before a part and a pattern."""
    terms = [("in the", "exact", "phrase"), ("ing", "exact", "partial"), ("z{3}", "exact", "regex")] + [(f"never {k}", "exact", "phrase") for k in range(6000)]
    lexicon = spark.createDataFrame(terms, "term string, tier string, kind string")
    docs = spark.createDataFrame([(1, "in the morning"), (2, "something"), (3, "zzz"), (4, "fine"), (5, "never 5999")], "doc_id long, text string")
    out = {r.doc_id: (r.layer, r.reason) for r in R.verdict(docs, lexicon, profile=None, many_forms=many_forms).collect()}
    assert out == {1: ("dict", "phrase"), 2: ("dict", "partial"), 3: ("dict", "regex"), 4: ("-", None), 5: ("dict", "phrase")}
    assert R.verdict(docs.where("doc_id = 4"), lexicon.where(F.col("kind") == "word"), profile=None).first().layer == "-"


def whole_text_forms(docs, lexicon, **options):
    """Every form of every text as a text of its own."""
    many = docs.select("doc_id", F.posexplode(L.forms(F.col("text"))).alias("form_no", "form")).select(F.struct("doc_id", "form_no").alias("form_key"), T.tokens(F.col("form")).alias("tokens"))
    found = L.match(many, lexicon, "form_key", **options)
    return found.groupBy(F.col("form_key.doc_id").alias("doc_id")).agg(*(F.bool_or(c).alias(c) for c in ("exact", "contextual", "pejorative")), F.min_by("culprit", "form_key.form_no").alias("culprit"))


@pytest.mark.parametrize("most", [0, 100_000])
def test_forms_of_tokens_are_forms_of_texts(spark, monkeypatch, most):
    """Shaping the distinct tokens gives what shaping whole texts gives, with a hit table sent to the tasks or joined."""
    monkeypatch.setattr(L, "BROADCAST_ROWS", most)
    rng = random.Random(11)
    words = ["غبي", "غغبي", "غ.ب.ي", "غبيي", "حماره", "حمارة", "يا", "انت", "كلمه", "كلمة", "برمجه", "و", "--", "ابن", "طيبه", "a.b", "كلب", "ككلب،كلب"]
    texts = [(k, rng.choice((" ", "  ", "\n")).join(rng.choice(words) for _ in range(rng.randint(0, 8)))) for k in range(300)] + [(300, None), (301, "غبي")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    lexicon = spark.createDataFrame([("غبي", "exact", "word"), ("حمارة", "contextual", "word"), ("كلب", "pejorative", "word"), ("كلمة", "exact", "word")], "term string, tier string, kind string")
    exempt = spark.createDataFrame([("طيبة",)], "term string")
    registers = spark.createDataFrame([("كلمة", "برمجه"), ("غبي", "و")], "term string, cue string")
    for stemming in (True, False):
        options = {"stemming": stemming, "exempt": exempt, "registers": registers}
        got, want = ({tuple(r) for r in f(docs, lexicon, **options).collect()} for f in (L.match_forms, whole_text_forms))
        assert got == want and len(got) > 100


def test_hybrid(spark):
    """Dictionary, repair, and the greatest score over the clean text and its candidates, as a loop has it."""
    lexicon = spark.createDataFrame([("غبي", "exact", "word")], "term string, tier string, kind string")
    texts = {1: "انت غبي", 2: "يا غىىىبي", 3: "كلام طيب جدا", 4: "حماىىىر كبير", 5: "حمار كبير", 6: "", 7: None, 8: "كىىىلب وحماىىىر"}
    scores = lambda t: 0.9 if "حمار" in t and "كبير" in t else 0.6 if "كلب" in t else 0.2

    def scorer(df):
        return spark.createDataFrame([(r.text, "x", scores(r.text)) for r in df.collect()], "text string, label string, score double")

    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r.doc_id: r for r in R.hybrid(docs, lexicon, scorer, profile=None).collect()}
    assert out.keys() == texts.keys()
    for i, text in texts.items():
        tokens = (text or "").split()
        if i in (1, 2):
            assert (out[i].is_toxic, out[i].score, out[i].source, out[i].calls) == (True, 1.0, {1: "dict", 2: "resolver:غبي"}[i], 0)
            continue
        made = []
        if any("ىى" in t for t in tokens):
            evasive = [k for k, t in enumerate(tokens) if "ىى" in t]
            for k in evasive:
                made += [" ".join([*tokens[:k], c, *tokens[k + 1 :]]) for c in R.repairs(tokens[k])]
            made = list(dict.fromkeys(made))[:4]
        best, source = scores(text or ""), "model_clean"
        for c in made:
            if scores(c) > best:
                best, source = scores(c), f"model_cand:{c}"
        assert (out[i].score, out[i].source, out[i].calls, out[i].is_toxic) == (best, source, len(made), best >= 0.5), i

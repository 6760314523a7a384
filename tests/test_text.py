"""Goldens of normalisation, filters and rules, in Arabic script, which the tables don't hold."""

import pytest
from pyspark.sql import functions as F

from tamarisk.functions import arabizi
from tamarisk.functions import text as T
from tamarisk.operators import labels as B
from tamarisk.operators import lexicon as L
from tamarisk.operators import rules as R
from tamarisk.operators import splits as S
from tamarisk.operators.html import blocks
from tamarisk.streaming.moderation import attempt


def one(spark, expression, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, profile, expected",
    [
        ("يا ك ل ب", "corpus", "ياكلب"),
        ("يا ك ل ب", "runtime", "يا كلب"),
        ("مَرْحَبًا", "corpus", "مرحبا"),
        ("جمـــيل", "corpus", "جميل"),
        ("أحمد إلى آخر", "corpus", "احمد الى اخر"),
        ("هههههه", "corpus", "هه"),
        ("نص https://a.b/c @محمد RT user 12", "corpus", "نص"),
        ("مدرسة", "corpus", "مدرسة"),
        ("مدرسة", "runtime", "مدرسه"),
        ("ﻻ شيء", "corpus", "لا شيء"),
        ("سلام &amp; نور", "corpus", "سلام نور"),
        ("لا، نعم", "corpus", "لا، نعم"),
        ("لا نعم", "corpus", "لا نعم"),
        ("", "corpus", ""),
        (None, "corpus", ""),
        ("سـ​لام", "runtime", "سلام"),
        ("كتاب ؤب آخر", "runtime", "كتاب وب اخر"),
    ],
)
def test_normalize(spark, raw, profile, expected):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(T.normalize(F.col("t"), profile).alias("x")).first()["x"] == expected


@pytest.mark.parametrize("text, strict, shown", [("سلام hi", True, True), ("hello سل", False, False), ("123", False, False), ("ﻻ", False, True), ("", False, False)])
def test_scripts(spark, text, strict, shown):
    assert one(spark, T.is_arabic_script(F.col("t")), t=text) is strict
    assert one(spark, T.has_arabic(F.col("t")), t=text) is shown


def test_small_functions(spark):
    assert one(spark, T.strip_separators(F.col("t")), t="س.ل-ا م") == "سلا م"
    assert one(spark, T.compress_repeats(F.col("t")), t="ساااالم") == "سالم"
    assert one(spark, T.fold_variants(F.col("t")), t="مدرسةى") == "مدرسهي"
    assert one(spark, T.reverse_fold(F.col("t")), t="مدرسه") == "مدرسة"
    assert one(spark, T.fold_dialect(F.col("t")), t="چگصثذظ") == "كقسسزض"
    assert one(spark, T.split_bulk(F.col("t")), t="a, b،a\n ,c") == ["a", "b", "c"]
    assert one(spark, T.strip(F.col("t")), t="  a  ") == "a"
    assert one(spark, T.host(F.col("t")), t="https://A.example.com/x") == "a.example.com"


def test_arabizi(spark):
    assert one(spark, arabizi.is_arabizi(F.col("t")), t="3ala fikra") is True
    assert one(spark, arabizi.is_arabizi(F.col("t")), t="plain words") is False
    assert one(spark, arabizi.transliterate(F.col("t")), t="sha7 3ala") == "شح علا"


@pytest.mark.parametrize("label, expected", [("Yes", 1), ("yes", 1), ("NO", 0), ("1.0", None), (None, None)])
def test_map_label(spark, label, expected):
    df = spark.createDataFrame([(label,)], "l string")
    assert df.select(B.map_label(F.col("l"), {"yes": 1, "no": 0, "1": 1}).alias("x")).first()["x"] == expected


def test_bespoke_labels(spark):
    tags = spark.createDataFrame([(["Clean"],), (["Clean", "Hate"],), ([],), (None,)], "t array<string>")
    assert [r.x for r in tags.select(B.no_clean_tag(F.col("t")).alias("x")).collect()] == [0, 1, 0, 0]
    df = spark.createDataFrame([("Yes-directed", None), ("no", " YES "), (None, "x")], "a string, b string")
    assert [r.x for r in df.select(B.any_answer(df, ["a", "b", "missing"], ("yes", "yes-directed")).alias("x")).collect()] == [1, 1, 0]
    assert one(spark, B.is_corrupt(F.col("t")), t="x" * 31) and not one(spark, B.is_corrupt(F.col("t")), t="HOF")
    assert one(spark, B.says_offensive(F.col("t")), t="Not offensive") == 0


def test_vote_ties_and_lineage(spark):
    df = spark.createDataFrame([("a", 0, "s2", "x"), ("a", 1, "s1", "y"), ("a", 1, "s1", "y"), ("a", 0, "s3", "x"), ("b", 1, "s1", "x")], "text string, label int, source string, dialect string")
    safe = {r.text: r for r in B.vote(df).collect()}
    assert safe["a"].label == 0 and safe["a"].source == "s1|s2|s3" and safe["a"].dialect == "x|y"
    assert {r.text: r.label for r in B.vote(df, "toxic").collect()} == {"a": 1, "b": 1}


def test_split_is_disjoint_and_in_proportion(spark):
    df = spark.range(4000).select(F.concat(F.lit("t"), "id").alias("text"), (F.col("id") % 4 == 0).cast("int").alias("label"))
    hashed = S.stratified(df, "label", "text")
    assert S.leakage(hashed).count() == 0
    shares = {r.split: r["n"] / 4000 for r in hashed.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert abs(shares["train"] - 0.8) < 0.03 and abs(shares["test"] - 0.1) < 0.03
    exact = {(r.label, r.split): r.n for r in S.exact_split(df, "label", "text").groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    assert exact[1, "train"] == 800 and exact[0, "val"] == 300


LEXICON = [("غبي", "exact", "word"), ("كلب", "contextual", "word"), ("نجس", "pejorative", "word")]


@pytest.mark.parametrize(
    "text, tiers",
    [("هذا غبي", {"exact"}), ("والغبي هنا", {"exact"}), ("كلب صغير", set()), ("يا كلب", {"contextual"}), ("يا ابن كلب", {"contextual"}), ("نجس", {"pejorative"}), ("ماء نجس شرعا", set()), ("انت نجس", {"pejorative"}), ("ويا كلب", {"contextual"})],
)
def test_tiers(spark, text, tiers):
    docs = spark.createDataFrame([(1, text.split())], "doc_id long, tokens array<string>")
    found = L.match(docs, spark.createDataFrame(LEXICON, "term string, tier string, kind string")).first()
    assert ({c for c in ("exact", "contextual", "pejorative") if found[c]} if found else set()) == tiers


def test_exemptions_and_registers(spark):
    lexicon = spark.createDataFrame([("غبي", "exact", "word")], "term string, tier string, kind string")
    docs = spark.createDataFrame([(1, ["غبي", "طب"]), (2, ["يا", "غبي", "طب"]), (3, ["غبي"])], "doc_id long, tokens array<string>")
    registers = spark.createDataFrame([("غبي", "طب")], "term string, cue string")
    assert {r.doc_id for r in L.match(docs, lexicon, registers=registers).collect()} == {2, 3}
    assert L.match(docs, lexicon, exempt=spark.createDataFrame([("غبي",)], "term string")).count() == 0


def test_look_alikes(spark):
    """Every pair by itself, so that no letter moves to its neighbour's place."""
    df = spark.createDataFrame([(k, v) for k, v in T.CONFUSABLES.items()], "k string, v string")
    assert df.where(T.fold_homoglyphs(F.col("k")) != F.col("v")).count() == 0
    assert one(spark, T.fold_homoglyphs(F.col("t")), t="پچگ۰ڵۃ") == "بجق0لة"
    assert one(spark, T.nfkc(F.col("t"), unescape=True), t="ﻻ &amp; ①") == "لا & 1"


@pytest.mark.parametrize("token, evasive", [("غىىبي", True), ("كىب", True), ("aىb", True), ("غ.بي", True), ("غ-بي", True), ("غ_بي", True), ("غ!بي", True), ("غ%بي", False), ("غ+بي", False), ("على", False), ("غبي", False)])
def test_evasion_signature(spark, token, evasive):
    assert one(spark, R.evades(F.col("t")), t=token) is evasive


def test_repairs():
    assert R.repairs("كىىىم")[:2] == ["كسم", "كم"]
    assert R.repairs("كىم")[0] != "كسم" and "كام" in R.repairs("كىم")
    assert R.repairs("غ*بي")[0] == "ع*بي" and "غبي" in R.repairs("غ*بي")


def test_expanded_words():
    assert {"لب", "الب"} < set(L.stems("والب")) | {"لب"} and "الب" in L.stems("والب")
    assert "كلبه" in L.spellings("جلبة") and "كلبة" in L.spellings("جلبة")
    assert "كصه" not in L.spellings("چصه") and "كسه" in L.spellings("چصه")


def test_verdict_as_shipped(spark):
    """Morphology, forms, phrases, parts, patterns, allowed words and the model in one call."""
    lexicon = spark.createDataFrame(
        [("غبي", "exact", "word"), ("كلب", "contextual", "word"), ("ضرب", "pejorative", "word"), ("ابن الناس", "exact", "phrase"), ("حمار", "exact", "partial"), ("^سوء.*جدا$", "exact", "regex"), ("[", "exact", "regex")],
        "term string, tier string, kind string",
    )
    texts = {1: "انت غ،بي", 2: "غغغبييي", 3: "ابن الناس هنا", 4: "كالحماره", 5: "سوء كبير جدا", 6: "هذا ابن كلام طويل", 7: "سعيد غبي", 8: "كلام آخر هنا طويل", 9: "يا كلب"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")

    def scorer(df):
        return df.select("text", F.when(F.col("text").contains("اخر"), "TOXIC").otherwise("SAFE").alias("label"), F.lit(0.9).alias("score"))

    found = {r.doc_id: (r.layer, r.is_toxic) for r in R.verdict(docs, lexicon, scorer=scorer, roots=("ضرب",)).collect()}
    assert found == {1: ("dict", True), 2: ("dict", True), 3: ("dict", True), 4: ("dict", True), 5: ("dict", True), 6: ("-", False), 7: ("dict", True), 8: ("model", True), 9: ("dict", True)}
    spared = {r.doc_id: r.layer for r in R.verdict(docs, lexicon, allowed=("غبي",)).collect()}
    assert spared[7] == "-" and spared[9] == "dict"


def test_exempt_names_are_stemmed(spark):
    lexicon = spark.createDataFrame([("غبي", "exact", "word")], "term string, tier string, kind string")
    docs = spark.createDataFrame([(1, ["والغبي"]), (2, ["غبيين"])], "doc_id long, tokens array<string>")
    assert L.match(docs, lexicon).count() == 2
    assert L.match(docs, lexicon, exempt=spark.createDataFrame([("غبي",)], "term string")).count() == 0


def test_stems_keep_short_stems():
    assert "زبون" in L.stems("الزبون") and "زب" not in L.stems("الزبون")
    assert "جسم" in L.spellings("جسم") and "كسم" not in L.spellings("جسم")


def test_resolver_and_emoji(spark):
    lexicon = spark.createDataFrame([("غبي", "exact", "word")], "term string, tier string, kind string")
    docs = spark.createDataFrame([(1, ["انت", "غىىىبي"]), (2, ["غيبي", "جدا"])], "doc_id long, tokens array<string>")
    assert {(r.doc_id, r.token) for r in R.resolve(docs, lexicon).collect()} == {(1, "غىىىبي")}
    e = one(spark, R.emoji(F.col("t")), t="يا 🐶")
    assert e.is_toxic and e.flags == ["directed_animal_insult"] and e.extracted == "[إهانة موجهة]"
    assert one(spark, R.emoji(F.col("t")), t="you 🐶").flags == ["undirected_animal"]
    assert not one(spark, R.emoji(F.col("t")), t="🔪").is_toxic
    assert one(spark, R.emoji(F.col("t")), t="🖕🔪").score == 1.0


def test_layers(spark):
    lexicon = spark.createDataFrame([("غبي", "exact", "word")], "term string, tier string, kind string")
    docs = spark.createDataFrame([(1, "💩"), (2, "انت غبي"), (3, "انت غىىىبي"), (4, "سلام عليكم"), (5, None)], "doc_id long, text string")
    assert {r.doc_id: r.layer for r in R.verdict(docs, lexicon).collect()} == {1: "emoji", 2: "dict", 3: "resolver", 4: "-", 5: "-"}


def test_disguise_keeps_safe_text_safe(spark):
    from tamarisk.operators.suite import disguised

    lexicon = spark.createDataFrame([("غبي", "exact", "word")], "term string, tier string, kind string")
    made = disguised(spark.createDataFrame([("سلام",)], "word string")).withColumn("doc_id", F.monotonically_increasing_id())
    assert R.verdict(made, lexicon).where("is_toxic").count() == 0


def test_blocks():
    page = "<div><p>one <b>two</b> <a>three</a></p><script>no</script><p>x<br>y</p></div>"
    assert blocks(page) == [("p", "one two three"), ("p", "xy")]
    long = "<div>" + "<span>" + "a" * 1500 + "</span><span>" + "b" * 1500 + "</span></div>"
    assert [t for t, _ in blocks(long)] == ["span", "span"]


def test_lockout():
    state, outcomes = (0, 0.0), []
    for at, ok in [(i, False) for i in range(6)] + [(10, True), (36, False), (37, True), (200, True)]:
        state, outcome, until = attempt(state, at, ok)
        outcomes.append(outcome)
    assert outcomes == ["fail"] * 6 + ["locked", "fail", "locked", "ok"]
    assert state == (0, 0.0)

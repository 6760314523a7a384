"""Registered queries without a twin take whole texts: small tables against brute force."""

import pytest

from tamarisk.functions import arabizi
from tamarisk.operators import rules as R
from tamarisk.plans import registry

HEAD = "غىىىبي"
TEXTS = {
    1: "one two three four five وغىىىبي",
    2: "ok " + "plain words without any mark " * 5 + "3ala",
    3: "a b",
    4: "",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(i, t, "en", "s") for i, t in TEXTS.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    return d


def test_transliterate(spark, folder):
    read = arabizi.transliterator()
    out = {r.doc_id: r.arabic for r in registry.QUERIES["transliterate"](spark, folder).collect()}
    # Arabic script is never taken as Arabizi
    assert out == {i: "3ala " + t if i == 1 else " ".join(map(read, ("3ala " + t).split())) for i, t in TEXTS.items()}


def test_hard_negative_suite(spark, folder):
    texts = {r.text for r in registry.QUERIES["hard_negative_suite"](spark, folder).collect()}
    for t in TEXTS.values():
        assert {t, f"he said {t}", ".".join(t), " ".join(t), t[:1] * 4 + t[1:]} <= texts
    assert texts == {x for t in TEXTS.values() for x in (t, f"he said {t}", t[:1] * 4 + t[1:], *(s.join(t) for s in (".", " ", "ـ", "\u064e", "\u200b")))}


def test_sentence_candidates(spark, folder):
    expected = set()
    for i, t in TEXTS.items():
        tokens = [HEAD, *t.split(" ")]
        evasive = {k for k, w in enumerate(tokens) if "غىىىبي" in w}
        ranked = {}
        for k, w in enumerate(tokens):
            if len(w) >= 3:
                for j, c in enumerate(R.repairs(w)[: R.BUDGET]):
                    text, rank = " ".join([*tokens[:k], c, *tokens[k + 1 :]]), (k not in evasive, k, j)
                    ranked[text] = min(ranked.get(text, rank), rank)
        expected |= {(i, p, x) for p, x in enumerate(sorted(ranked, key=ranked.get)[: R.BUDGET], 1)}
    assert {tuple(r) for r in registry.QUERIES["sentence_candidates"](spark, folder).collect()} == expected


def test_resolver_repairs(spark, folder, monkeypatch):
    tokens = []
    resolve = R.resolve
    monkeypatch.setattr(registry.R, "resolve", lambda docs, lexicon: tokens.extend(docs.collect()) or resolve(docs, lexicon))
    found = {r.doc_id: r.token for r in registry.QUERIES["resolver_repairs"](spark, folder).collect()}
    assert {r.doc_id: r.tokens for r in tokens} == {i: [HEAD, *t.split(" ")] for i, t in TEXTS.items()}
    assert found == dict.fromkeys(TEXTS, HEAD)


def test_script_flags(spark, folder):
    out = {r.doc_id: (r.arabic_script, r.has_arabic, r.arabizi) for r in registry.QUERIES["script_flags"](spark, folder).collect()}
    assert out == {i: (False, False, i == 2) for i in TEXTS}

"""Test suites by rule: surface disguises, carriers and hard negatives, in an order fixed by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.operators.splits import seeded


#: What an adversarial suite hides words by.
OBFS = ("dots", "spaces", "elongate", "tatweel", "diacritics", "zero_width", "mask")


def disguises(word: Column) -> dict[str, Column]:
    """Name -> disguised word; ``plain`` is the word itself."""
    letters = F.split(word, "")
    joined = lambda sign: F.array_join(letters, sign)
    first, rest = F.left(word, F.lit(1)), F.substring(word, F.lit(2), F.length(word))
    middle = F.floor(F.length(word) / 2).cast("int")
    head, tail = F.left(word, middle), F.substring(word, middle + 1, F.length(word))
    return {
        "plain": word,
        "dots": joined("."), "spaces": joined(" "), "dashes": joined("-"), "underscore": joined("_"),
        "elongate": F.concat(F.repeat(first, F.lit(4)), rest),
        "tatweel": joined("ـ"), "diacritics": joined("َ"), "zero_width": joined("​"),
        "alef_swap": F.translate(word, "ا", "أ"), "farsi": F.translate(word, "كي", "کی"), "ta_marbuta": F.regexp_replace(word, "ه$", "ة"),
        "cyrillic": F.translate(word, "اهaeo", "аеаео"),
        "filler": F.concat(head, F.lit("ىى"), tail), "mask": F.concat(head, F.lit("*"), tail),
    }


def disguised(words: DataFrame, word: str = "word", only: tuple[str, ...] | None = None) -> DataFrame:
    """``words`` with (obf, text): a row for each disguise."""
    made = [F.struct(F.lit(n).alias("obf"), c.alias("text")) for n, c in disguises(F.col(word)).items() if only is None or n in only]
    return words.select("*", F.inline(F.array(*made)))


def generate(seeds: DataFrame, morphs: list[tuple[str, str]], carriers: list[str], target: int, seed: int = 42, carried: int = 60, safe_frames: list[str] | None = None) -> DataFrame:
    """(text, expected, dialect, category, obf, morph): up to ``target`` distinct cases, half toxic and half safe as far as they go.

    ``seeds`` (word, expected, dialect, category); ``morphs`` (name, pattern with {}); ``carriers``
    are frames with {}, ``safe_frames`` those of safe seeds (else the same). Every seed meets every form, disguise and carrier: three nested
    expansions of each seed's own row by fixed lists, no join.
    """
    forms = seeds.select("expected", "dialect", "category", F.inline(F.array(*(F.struct(F.lit(n).alias("morph"), F.replace(F.lit(p), F.lit("{}"), F.col("word")).alias("form")) for n, p in morphs))))
    made = disguised(forms, "form")
    frames = F.when(F.col("expected") == 1, F.array(*map(F.lit, carriers))).otherwise(F.array(*map(F.lit, safe_frames or carriers)))
    framed = F.transform(frames, lambda c: F.replace(c, F.lit("{}"), F.col("text")))
    in_frame = F.pmod(F.xxhash64("text", "expected"), F.lit(100)) < carried
    cases = made.select("expected", "dialect", "category", "obf", "morph", F.explode(F.when(in_frame, framed).otherwise(F.array("text"))).alias("text"))
    cases = cases.groupBy("text", "expected").agg(F.min(F.struct("dialect", "category", "obf", "morph")).alias("of")).select("text", "expected", "of.*")
    order = seeded(F.col("text"), seed)
    half = (target + 1) // 2
    return cases.where("expected = 1").orderBy(order, "text").limit(half).union(cases.where("expected = 0").orderBy(order, "text").limit(target - half))


def pick(options: list[str], *salt: Column) -> Column:
    """One of the options, fixed by a hash."""
    return F.get(F.array(*map(F.lit, options)), F.pmod(F.xxhash64(*salt), F.lit(len(options))).cast("int"))


def adversarial(seeds: DataFrame, morphs: list[tuple[str, str]], carriers: list[str], safe_frames: list[str], context_frames: list[str], obfs: tuple[str, ...] = OBFS) -> DataFrame:
    """(text, expected, category): a small suite, each text once.

    ``seeds`` (word, expected, category, contextual boolean). A toxic seed stands plain, carried,
    inflected, disguised, and inflected and disguised; a safe one plain, framed and disguised;
    a contextual one, safe where nobody is addressed, in all context frames.
    """
    word = F.col("word")
    filled = lambda frame, w: F.replace(frame, F.lit("{}"), w)

    def hidden(w: Column, salt: str) -> Column:
        by_name = disguises(w)
        return F.get(F.array(*(by_name[n] for n in obfs)), F.pmod(F.xxhash64("word", F.lit(salt)), F.lit(len(obfs))).cast("int"))

    inflected = filled(pick([p for _, p in morphs], word, F.lit("morph")), word)
    toxic = F.array(word, filled(pick(carriers, word, F.lit("carrier")), word), inflected, hidden(word, "obf"), hidden(inflected, "both"))
    safe = F.array(word, filled(pick(safe_frames, word, F.lit("frame")), word), hidden(word, "obf"))
    framed = F.array(*(filled(F.lit(f), word) for f in context_frames))
    made = F.when(F.col("contextual"), framed).when(F.col("expected") == 1, toxic).otherwise(safe)
    cases = seeds.select(F.explode(made).alias("text"), F.when(F.col("contextual"), 0).otherwise(F.col("expected")).alias("expected"), "category")
    return cases.where("text IS NOT NULL AND text != ''").groupBy("text", "expected").agg(F.min("category").alias("category"))


def hard_negatives(texts: DataFrame, frames: list[str] | dict[str, list[str]], obfs: tuple[str, ...] = ("dots", "spaces", "elongate", "tatweel", "diacritics", "zero_width")) -> DataFrame:
    """(text, expected = 0, category, flags): safe texts in frames and in disguise, each once.

    ``frames`` by category, or one list for all; a category without frames is only disguised. The cases are many times
    their texts, so only hashes of them are shuffled; each is made again where its text lies.
    """
    listed = lambda f: F.array(*map(F.lit, f)).cast("array<string>")
    if isinstance(frames, dict):
        own = listed([])
        for category, some in frames.items():
            own = F.when(F.col("category") == category, listed(some)).otherwise(own)
    else:
        own = listed(frames)
    hidden = {n: c for n, c in disguises(F.col("text")).items() if n in obfs}
    framed = F.transform(own, lambda f: F.struct(F.replace(f, F.lit("{}"), F.col("text")).alias("text"), F.array(F.lit("framed")).alias("flags")))
    made = F.concat(framed, F.array(*(F.struct(c.alias("text"), F.array(F.lit("disguised"), F.lit(n)).alias("flags")) for n, c in hidden.items())))
    # 128 bits of SHA-256 stand for a text, none for null
    hashed = lambda c: F.coalesce(F.unhex(F.left(F.sha2(c, 256), F.lit(32))), F.lit(b""))
    keyed = texts.select("category", "text", hashed(F.col("text")).alias("source"))
    cases = keyed.select("source", "category", F.posexplode(F.transform(made, lambda c: F.struct(hashed(c.text).alias("hash"), c.flags.alias("flags")))).alias("slot", "c"))
    won = cases.groupBy("c.hash").agg(F.min("category").alias("category"), F.min("c.flags").alias("flags"), F.min(F.struct("source", "category", "slot")).alias("of"))
    won = won.groupBy("of.source", F.col("of.category").alias("own")).agg(F.collect_list(F.struct("of.slot", "category", "flags")).alias("won"))
    sources = keyed.groupBy("source").agg(F.first("text").alias("text"))
    again = won.join(sources.hint("merge"), "source").select(F.col("own").alias("category"), "text", "won")
    picked = F.transform(made, lambda c, i: F.struct(c.text.alias("text"), F.get(F.filter("won", lambda w: w.slot == i), F.lit(0)).alias("w")))
    return again.select(F.inline(F.filter(picked, lambda c: c.w.isNotNull()))).select("text", F.lit(0).alias("expected"), "w.category", "w.flags")

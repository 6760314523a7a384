"""Labels of many datasets to one binary label, and one label a text by vote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tamarisk.functions import text as T


def map_label(label: Column, mapping: dict[str, int]) -> Column:
    """0/1 by the exact (trimmed) label, else by its lower case; null if unmapped."""
    pairs = F.create_map(*(F.lit(x) for k, v in mapping.items() for x in (str(k), int(v))))
    key = F.trim(label.cast("string"))
    return F.coalesce(F.try_element_at(pairs, key), F.try_element_at(pairs, F.lower(key)))


def any_positive(labels: list[Column], mapping: dict[str, int]) -> Column:
    """1 if any of the labels, as they are, maps to it; unmapped ones count as 0."""
    pairs = F.create_map(*(F.lit(x) for k, v in mapping.items() for x in (str(k), int(v))))
    values = [F.coalesce(F.try_element_at(pairs, c.cast("string")), F.lit(0)) for c in labels]
    return values[0] if len(values) == 1 else F.greatest(*values)


def is_corrupt(label: Column) -> Column:
    """A label that looks like a text: long, or with more than five Arabic letters."""
    bare = F.trim(label.cast("string"))
    return F.coalesce((F.length(bare) > 30) | (F.length(F.regexp_replace(bare, r"[^\x{0600}-\x{06FF}]", "")) > 5), F.lit(False))


def no_clean_tag(tags: Column, clean: tuple[str, ...] = ("Clean", "Humor", "Irony/sarcasm")) -> Column:
    """1 if any tag contains none of the clean ones; null or no tags: 0."""
    bad = F.exists(tags, lambda t: ~F.greatest(*(t.contains(c) for c in clean), F.lit(False)))
    return F.coalesce(bad, F.lit(False)).cast("int")


def any_answer(df: DataFrame, questions: list[str], positive: tuple[str, ...]) -> Column:
    """1 if any of the questions that exist has a positive answer (trimmed, in any case)."""
    there = [F.coalesce(F.lower(F.trim(df[q])).isin(*positive), F.lit(False)).cast("int") for q in questions if q in df.columns]
    return F.greatest(*there, F.lit(0)) if there else F.lit(0)


def either_positive(first: Column, first_value: str, second: Column, second_value: str) -> Column:
    return F.coalesce((F.lower(F.trim(first)) == first_value) | (F.lower(F.trim(second)) == second_value), F.lit(False)).cast("int")


def says_yes(value: Column, yes: str = "yes") -> Column:
    return F.coalesce(F.lower(F.trim(value)) == yes, F.lit(False)).cast("int")


def says_offensive(value: Column) -> Column:
    low = F.lower(value)
    return F.coalesce(low.contains("offensive") & ~low.contains("not"), F.lit(False)).cast("int")


def has_text() -> Column:
    return F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False))


def has_label() -> Column:
    """What a label map knew."""
    return F.col("label").isNotNull()


def with_text(df: DataFrame, label: bool = False, strip: bool = False) -> DataFrame:
    """Rows (text, ...) whose text is neither null nor blank, in all of Unicode's white space.

    ``label``: nor the label null. ``strip``: the text is kept without white space at its ends.
    """
    out = df.where(has_text())
    out = out.where(has_label()) if label else out
    return out.withColumn("text", T.strip(F.col("text"))) if strip else out


def routed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a label, rows without one, which a label map did not know)."""
    return df.where(has_label()), df.where(~has_label())


def write_routed(df: DataFrame, path: str, steps: list[tuple[str, Column]]) -> dict[str, int]:
    """Write each row to the folder ``route=`` of the first step (name, condition) that it fails, or ``route=kept``; how many rows came and were left after each step.

    One scan and one write; the counts come from the written files' footers. (An ``Observation`` would count on
    the way, but once a session has one, its ML models' tasks can't be serialised any more.) A condition that is null fails.
    """
    route = F.lit("kept")
    for name, c in reversed(steps):
        route = F.when(~F.coalesce(c, F.lit(False)), name).otherwise(route)
    df.withColumn("route", route).write.mode("overwrite").partitionBy("route").parquet(path)
    kind = df.schema if "route" in df.columns else StructType([*df.schema.fields, StructField("route", StringType())])
    n = {r.route: r.n for r in df.sparkSession.read.schema(kind).parquet(path).groupBy("route").agg(F.count("*").alias("n")).collect()}
    left = sum(n.values())
    told = {"raw": left}
    for name, _ in steps:
        left -= n.get(name, 0)
        told[name] = left
    return told


def once(value: Column) -> Column:
    """A selected column that is evaluated once a row: Spark moves a filter on it no deeper and puts its expression in no other's place."""
    return F.explode(F.array(value))


def prepare(df: DataFrame, text: str | int, label: str | list[str], mapping: dict[str, int], source: str, dialect: str = "Unknown", script: bool = True, shortest: int = 3, longest: int = 1000) -> tuple[DataFrame, DataFrame]:
    """((text, label, source, dialect, original_text) fit for a corpus, (text, label, source) of unknown labels).

    In order: no null or blank text, Arabic script, no text in the place of a label, known label,
    normalised text of ``shortest`` to ``longest`` characters, no replacement characters, not blank.
    Each is a filter on the raw row, so Spark reads it once for either result. The text that is handed in and the
    normalised one are made once a row, whatever looks at them.
    """
    value = (df[df.columns[text]] if isinstance(text, int) else df[f"`{text}`"]).cast("string")
    own = with_text(df.withColumn("text", value).select(*(f"`{c}`" for c in df.columns if c != "text"), once(F.col("text")).alias("text")))
    own = own.where(T.is_arabic_script(F.col("text"))) if script else own
    many = isinstance(label, list)
    if many:
        value = any_positive([own[f"`{c}`"] for c in label], mapping)
    else:
        own = own.where(~is_corrupt(own[f"`{label}`"]))
        value = map_label(own[f"`{label}`"], mapping)
    raw = own.select("text", F.lit(None).cast("string").alias("raw_label") if many else own[f"`{label}`"].cast("string").alias("raw_label"), value.alias("label"))
    known, unknown = routed(raw)
    clean = known.select(F.col("text").alias("original_text"), T.normalize(F.col("text")).alias("norm"), "label", F.lit(source).alias("source"), F.lit(dialect).alias("dialect"))
    clean = clean.select("original_text", once(F.col("norm")).alias("text"), "label", "source", "dialect")
    clean = with_text(clean.where(T.length_between(F.col("text"), shortest, longest) & ~T.has_mojibake(F.col("text"))))
    return clean.select("text", "label", "source", "dialect", "original_text"), unknown.select("text", F.col("raw_label").alias("label"), F.lit(source).alias("source"))


def standardize(df: DataFrame, text: str | int, label: str | list[str], mapping: dict[str, int], source: str, dialect: str = "Unknown") -> DataFrame:
    """(text, label, source, dialect) of a raw table, the text by name or place; unmapped labels stay null for :func:`routed`."""
    text = df.columns[text] if isinstance(text, int) else text
    value = any_positive([df[c] for c in label], mapping) if isinstance(label, list) else map_label(df[label], mapping)
    return df.select(df[text].cast("string").alias("text"), value.alias("label"), F.lit(source).alias("source"), F.lit(dialect).alias("dialect"))


def conflicts(df: DataFrame) -> DataFrame:
    """(text, n, mean) of the texts with both labels."""
    return df.groupBy("text").agg(F.count("label").alias("n"), F.avg("label").alias("mean")).where("mean > 0 AND mean < 1")


def vote(df: DataFrame, tie: str = "safe") -> DataFrame:
    """One row a text: majority label (ties by ``tie``) and sorted distinct sources and dialects, joined by ``|``.

    The documented rule sends ties to toxic; what the corpus was really built with sends them
    to safe, which is the default.
    """
    mean = F.avg("label")
    label = (mean >= 0.5) if tie == "toxic" else (mean > 0.5)
    lineage = [F.array_join(F.array_sort(F.collect_set(c)), "|").alias(c) for c in ("source", "dialect") if c in df.columns]
    return df.groupBy("text").agg(label.cast("int").alias("label"), *lineage)


def any_toxic(df: DataFrame) -> DataFrame:
    """One row a text: toxic if any copy is, with the first source in alphabetical order."""
    return df.groupBy("text").agg(F.max("label").alias("label"), F.min("source").alias("source"))


def flip_by_keywords(df: DataFrame, source: str, keywords: list[str]) -> DataFrame:
    """Safe rows of one source that contain a keyword become toxic (``flipped`` tells which)."""
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.col("text").contains(k)
    flipped = F.coalesce((F.col("source") == source) & (F.col("label") == 0) & hit, F.lit(False))
    return df.withColumn("flipped", flipped).withColumn("label", F.when(F.col("flipped"), 1).otherwise(F.col("label")))


def drop_long_safe(df: DataFrame, source: str, most: int = 300) -> DataFrame:
    return df.where(~F.coalesce((F.col("source") == source) & (F.col("label") == 0) & (F.length("text") > most), F.lit(False)))


def without_sources(df: DataFrame, names: list[str]) -> DataFrame:
    return df.where(~F.coalesce(F.col("source").isin(names), F.lit(False)))


def hold_out(df: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(rest, rows of the source)."""
    own = F.coalesce(F.col("source") == source, F.lit(False))
    return df.where(~own), df.where(own)


def new_texts(df: DataFrame, existing: DataFrame) -> DataFrame:
    return df.join(existing.select("text").distinct(), "text", "left_anti")

"""Deterministic samples, stratified splits and leakage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(key: Column, seed: int = 42) -> Column:
    """A reproducible random order: the same on any cluster and in any SQL engine."""
    return F.md5(F.concat(F.lit(str(seed)), key.cast("string")))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(seeded(F.col(key), seed), key).limit(n)


def stratified(df: DataFrame, label: str, key: str, parts: tuple[tuple[str, float], ...] = (("train", 0.8), ("val", 0.1), ("test", 0.1)), seed: int = 42) -> DataFrame:
    """``df`` with ``split``: by each row's share of the order within its label's rows.

    The rank comes from the row's hash alone (uniform on [0, 1)), so the split needs no
    shuffle, the same text is always in the same part, and parts of a label differ from their
    share by the sampling error only; :func:`exact_split` has exact shares.
    """
    unit = F.conv(F.substring(seeded(F.concat(F.coalesce(F.col(label).cast("string"), F.lit("")), F.lit("|"), F.col(key)), seed), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    cut, out = 0.0, None
    for name, share in parts[:-1]:
        cut += share
        out = F.when(unit < cut, name) if out is None else out.when(unit < cut, name)
    return df.withColumn("split", out.otherwise(parts[-1][0]) if out is not None else F.lit(parts[-1][0]))


def exact_split(df: DataFrame, label: str, key: str, parts: tuple[tuple[str, float], ...] = (("train", 0.8), ("val", 0.1), ("test", 0.1)), seed: int = 42) -> DataFrame:
    """``df`` with ``split`` in exact shares of each label's rows, in the order of :func:`seeded`.

    A row's rank is its place within its part of the order (4096 parts a label, by the hash's first
    digits) and the number of rows in the parts before: no task holds a whole label.
    """
    rows = df.withColumn("_order", seeded(F.col(key), seed)).withColumn("_part", F.substring("_order", 1, 3))
    counts = rows.groupBy(F.col(label).alias("_label"), F.col("_part").alias("_in")).agg(F.count("*").alias("_n"))
    by_label = Window.partitionBy("_label")  # over 4096 counts a label
    counts = counts.select("_label", "_in", (F.sum("_n").over(by_label.orderBy("_in")) - F.col("_n")).alias("_before"), F.sum("_n").over(by_label).alias("_all"))
    rows = rows.join(counts, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_part") == F.col("_in")))
    own = Window.partitionBy(label, "_part").orderBy("_order", key)
    share = (F.col("_before") + F.row_number().over(own) - 1) / F.col("_all")
    cut, out = 0.0, None
    for name, part in parts[:-1]:
        cut += part
        out = F.when(share < round(cut, 9), name) if out is None else out.when(share < round(cut, 9), name)
    rows = rows.withColumn("split", out.otherwise(parts[-1][0]) if out is not None else F.lit(parts[-1][0]))
    return rows.select(*(F.col(f"`{c}`") for c in df.columns if c != "split"), "split")


def leakage(df: DataFrame, key: str = "text") -> DataFrame:
    """(left, right, n): the keys that two splits share, for all pairs of splits that share any."""
    own = df.select(key, "split").distinct()
    a, b = own.alias("a"), own.alias("b")
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.split") < F.col("b.split"))).groupBy(F.col("a.split").alias("left"), F.col("b.split").alias("right")).agg(F.count("*").alias("n"))


def newest(df: DataFrame, by: str, most: int, order: str) -> DataFrame:
    """The last ``most`` rows of each key: a bounded log."""
    latest = Window.partitionBy(by).orderBy(F.col(order).desc())
    return df.withColumn("rank", F.row_number().over(latest)).where(F.col("rank") <= most)

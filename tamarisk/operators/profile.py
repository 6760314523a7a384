"""Profiling aggregates: distributions, funnels, coverage, column profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shares(df: DataFrame, key: str, digits: int = 2) -> DataFrame:
    """(key, n, pct): the window runs over one row a key, not over the table."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), digits))


def value_counts(df: DataFrame, value: Column, k: int | None = None) -> DataFrame:
    out = df.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "value").limit(k) if k else out


def exploded_counts(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Value counts of the ``|``-joined parts."""
    return value_counts(df.select(F.explode(F.split(column, r"\|")).alias("part")), F.col("part"), k)


def distinct_parts(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """How many distinct ``|``-joined parts there are, of all rows or a row of ``by``."""
    parts = df.select(*([by] if by else []), F.explode(F.split(column, r"\|")).alias("part"))
    return parts.groupBy(*([by] if by else [])).agg(F.count_distinct("part").alias("n_parts"))


def keyword_coverage(df: DataFrame, keywords: DataFrame) -> DataFrame:
    """(category, hits, rows, pct) of toxic rows: ``hits`` counts a row once a keyword, ``rows`` once.

    ``keywords`` (category, keyword) is a small parameter table: it becomes one conditional sum
    a keyword over a single pass, so nothing is joined or multiplied.
    """
    pairs = [(r.category, r.keyword) for r in keywords.select("category", "keyword").distinct().orderBy("category", "keyword").collect()]
    toxic = df.where("label = 1")
    categories = sorted({c for c, _ in pairs})
    sums = [F.count("*").alias("total")]
    for i, c in enumerate(categories):
        hits = [F.coalesce(F.col("text").contains(k), F.lit(False)).cast("long") for x, k in pairs if x == c]
        total = hits[0]
        for h in hits[1:]:
            total = total + h
        sums += [F.coalesce(F.sum(total), F.lit(0)).alias(f"h{i}"), F.count_if(total > 0).alias(f"r{i}")]
    row = toxic.agg(*sums)
    rows = F.array(*(F.struct(F.lit(c).alias("category"), F.col(f"h{i}").alias("hits"), F.col(f"r{i}").alias("rows")) for i, c in enumerate(categories)))
    return row.select("total", F.inline(rows)).select("category", "hits", "rows", F.round(F.coalesce(F.try_divide(100.0 * F.col("hits"), F.col("total")), F.lit(0.0)), 4).alias("pct"))


def toxic_rate(df: DataFrame) -> DataFrame:
    """(source, n, toxic, rate) by exact source."""
    out = df.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("toxic"))
    return out.withColumn("rate", F.round(100.0 * F.col("toxic") / F.col("n"), 4))


def toxic_rate_by_substring(df: DataFrame, k: int = 25) -> DataFrame:
    """The same for the top k first sources, each counting all rows whose source *contains* it.

    Rows are first counted by distinct source; the containment runs over those few counts.
    """
    top = df.groupBy(F.split_part("source", F.lit("|"), F.lit(1)).alias("name")).agg(F.count("*").alias("own")).orderBy(F.desc("own"), "name").limit(k).select("name")
    by = df.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("toxic"))
    both = by.join(F.broadcast(top), F.col("source").contains(F.col("name")))  # at most k rows are broadcast
    out = both.groupBy("name").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    return out.withColumn("rate", F.round(100.0 * F.col("toxic") / F.col("n"), 4))


def crosstab(df: DataFrame, row: str, label: str = "label", k: int = 8) -> DataFrame:
    """Counts of label 0 and 1 for the k most frequent first parts of ``row``."""
    out = df.groupBy(F.split_part(row, F.lit("|"), F.lit(1)).alias("value")).agg(F.count_if(F.col(label) == 0).alias("safe"), F.count_if(F.col(label) == 1).alias("toxic"), F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "value").limit(k).select("value", "safe", "toxic")


def length_histogram(df: DataFrame, text: str = "text", label: str = "label", bins: int = 50, low: int = 0, high: int = 1000) -> DataFrame:
    """(label, bin, n): equal bins from low to high; what lies outside goes to the outer bins."""
    width = (high - low) / bins
    place = F.least(F.greatest(F.floor((F.length(text) - low) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(text).isNotNull()).groupBy(label, place.alias("bin")).agg(F.count("*").alias("n"))


def length_median(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """(label, median_length): exact, over counts by length, which are few whatever the table's size."""
    counts = df.where(F.col(text).isNotNull()).groupBy(label, F.length(text).alias("length")).agg(F.count("*").alias("n"))
    return counts.groupBy(label).agg(F.expr("percentile(length, 0.5, n)").alias("median_length"))


def funnel(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """(step, n, pct) after each filter on top of those before it, in one pass."""
    passed, counts = F.lit(True), [F.count("*").alias("c0")]
    for i, (_, condition) in enumerate(steps, 1):
        passed = passed & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(passed).alias(f"c{i}"))
    rows = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(n).alias("step"), F.col(f"c{i}").alias("n")) for i, n in enumerate(["raw", *(s for s, _ in steps)])))
    return df.agg(*counts).select("c0", F.inline(rows)).select("place", "step", "n", F.round(F.coalesce(F.try_divide(100.0 * F.col("n"), F.col("c0")), F.lit(0.0)), 4).alias("pct"))


def columns(df: DataFrame) -> DataFrame:
    """(column, type, nulls, distinct_values) of every column, in one aggregation each kind."""
    counts = df.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)), *(F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(df.columns)))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"n{i}").alias("nulls"), F.col(f"d{i}").alias("distinct_values")) for i, (c, t) in enumerate(df.dtypes)))
    return counts.select(F.inline(rows))


def inspect(df: DataFrame, few: int = 20, head: int = 3) -> DataFrame:
    """:func:`columns` and, where a column has at most ``few`` values, a map of their counts; and its first ``head`` values.

    A first pass tells by sketches which columns could have so few values; only their cells are
    counted by value, so that no texts or keys are shuffled for that.
    """
    sketches = df.agg(*(F.approx_count_distinct(F.col(f"`{c}`"), 0.02).alias(f"a{i}") for i, c in enumerate(df.columns))).first()
    # far beyond a sketch's error: a column that is left out has more values
    likely = [c for c, n in zip(df.columns, sketches, strict=True) if n <= 2 * few + 10]
    first = df.limit(head).agg(*(F.collect_list(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null"))).alias(f"h{i}") for i, c in enumerate(df.columns)))
    first = first.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"h{i}").alias("head")) for i, c in enumerate(df.columns)))))
    cells = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in likely)))) if likely else df.sparkSession.createDataFrame([], "column string, value string")
    by_value = cells.where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    small = by_value.groupBy("column").agg(F.count("*").alias("distinct_values")).where(F.col("distinct_values") <= few).select("column")
    values = by_value.join(small, "column").groupBy("column").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("values"))
    return columns(df).join(values, "column", "left").join(first, "column", "left")


def duplicates(df: DataFrame, key: str = "text") -> DataFrame:
    return df.agg((F.count(key) - F.count_distinct(key)).alias("n_duplicates"))


def assert_unique(df: DataFrame, key: str = "text") -> DataFrame:
    """``n_duplicates`` = 0, or the query fails."""
    n = duplicates(df, key)
    return n.select(F.when(F.assert_true(F.col("n_duplicates") == 0, "duplicate keys").isNull(), F.col("n_duplicates")).alias("n_duplicates"))

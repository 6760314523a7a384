"""Bottom-k sketches of documents, in DataFrame functions only.

A sketch is the sorted array of the ``k`` smallest 64-bit hashes of a text's distinct
shingles (runs of five words; with fewer words the whole sequence; none without words).
Sketches of parts merge into the sketch of the whole, and two of them estimate
resemblance, containment and the number of distinct shingles; below ``k`` shingles
of the union all of these are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.llm import words as W

WIDTH, K = 5, 128
BLANKS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Array of words; empty without any."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def shingles(text: Column, width: int = WIDTH) -> Column:
    """Distinct shingle hashes of a text (not null)."""
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        runs = F.transform(F.slice(h, 1, F.size(h) - (width - 1)), lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, width))))
        short = F.array(F.xxhash64(F.array_join(h.cast("array<string>"), ",")))
        return F.when(F.size(h) >= width, runs).when(F.size(h) > 0, short).otherwise(F.array().cast("array<bigint>"))

    # bound once as a lambda variable, so that the windows don't compute it again
    return F.array_distinct(F.flatten(F.transform(F.array(hashes), windows)))


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(hashes), 1, k)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """The sketch of a text; null counts as empty. Equal texts have equal sketches."""
    return bottom(shingles(F.coalesce(text, F.lit("")), width), k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sets, from their sketches."""
    return bottom(F.array_union(a, b), k)


def merge_groups(sketches: DataFrame, key: str, column: str, k: int = K, salts: int = 64) -> DataFrame:
    """(key, column): one sketch a key from any number of parts.

    Parts of a key merge first within ``salts`` groups, so that no task gathers all of a hot
    key's parts at once; hashes meet as rows, of which each step keeps the ``k`` smallest.
    """
    rows = sketches.select(F.col(key), F.pmod(F.xxhash64(F.col(column)), F.lit(salts)).alias("s"), F.explode(column).alias("h")).distinct()
    inner = Window.partitionBy(key, "s").orderBy("h")
    few = rows.withColumn("r", F.row_number().over(inner)).where(F.col("r") <= k).select(key, "h").distinct()
    outer = Window.partitionBy(key).orderBy("h")
    few = few.withColumn("r", F.row_number().over(outer)).where(F.col("r") <= k)
    return few.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated size of intersection by size of union; 1 for two empty sets."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.greatest(F.size(union), F.lit(1)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated part of the first set that the second holds; 1 for an empty first set."""
    full = lambda x: F.when(F.size(x) >= k, F.element_at(x, -1))  # noqa: E731  no limit for a whole set
    limit = F.least(full(a), full(b))
    under = F.filter(a, lambda h: limit.isNull() | (h <= limit))
    return F.when(F.size(under) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(under, b)) / F.greatest(F.size(under), F.lit(1)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles, from how far up the k-th smallest hash lies."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def text_of(a: Column) -> Column:
    """A sketch as text: 16 hex digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _below(bounds: list, value: Column) -> Column:
    """How many of the sorted bounds are at most the value: in two steps of about sqrt each."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    last = max(bounds)
    coarse = F.size(F.filter(F.array(*(F.lit(int(g[0])) for g in groups)), lambda b: b <= value))
    fine = F.array(*(F.array(*(F.lit(int(x)) for x in (g + [last] * step)[:step])) for g in groups))
    inside = F.size(F.filter(F.element_at(fine, F.greatest(coarse, F.lit(1))), lambda b: b <= value))
    return F.when(value.isNull() | (coarse == 0), 0).otherwise(F.least((coarse - 1) * step + inside, F.lit(len(bounds))))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", blocks: int | None = None) -> DataFrame:
    """``docs`` (key, text) with ``next_text``: the following row's by key, the first's after the last.

    The texts are shuffled once, into blocks of neighbouring keys cut at quantiles of the
    keys. Each block's first row is also sent to the end of the block before, which makes
    every following row a neighbour in its own block. Only one bound and one first key a
    block come to the driver. Rows of equal keys are ordered by text; null keys come first.
    """
    spark = docs.sparkSession
    blocks = blocks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = [F.lit(i / blocks) for i in range(1, blocks)]
    bounds = docs.agg(F.percentile_approx(key, F.array(*at), F.lit(max(10000, 4 * blocks))).alias("q")).first()["q"] if at else []
    bounds = sorted(set(bounds or []))
    placed = docs.withColumn("block", _below(bounds, F.col(key)).cast("int"))
    firsts = {r["block"]: r["first"][0] for r in placed.groupBy("block").agg(F.min(F.struct(key)).alias("first")).collect()}
    order = sorted(firsts)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    size = (order[-1] + 1) if order else 1
    first = F.get(F.array(*(F.lit(firsts.get(b)).cast("long") for b in range(size))), F.col("block"))
    previous = F.get(F.array(*(F.lit(before.get(b, 0)) for b in range(size))), F.col("block"))
    leads = F.col(key).eqNullSafe(first)
    both = placed.select(key, text, F.posexplode(F.when(leads, F.array("block", previous)).otherwise(F.array("block"))).alias("ghost", "block"))
    return both.repartition("block")


def near_edits(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Sketches of every text and of its edited text, and their likenesses.

    Edited: the last half (rounded down) of the code points is replaced by as many of the
    next document's first ones, or all it has. Null text counts as empty; two empty sketches
    are alike (1.0); repeated rows follow each other; the only row of a table follows itself;
    an empty table gives an empty result; other columns are not read.
    """
    own = W.table(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    near = with_next(own).withColumn("print", sketch(F.col("text"), k, width))
    order = Window.partitionBy("block").orderBy("ghost", "doc_id", "text")
    near = near.withColumn("next_text", F.lead("text").over(order)).withColumn("next_print", F.lead("print").over(order)).where("ghost = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    near = near.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "print", "next_print")
    near = near.withColumn("edited_print", sketch(F.col("edited"), k, width))
    return near.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        text_of(F.col("print")).alias("fingerprint"),
        text_of(F.col("edited_print")).alias("edited_fingerprint"),
        resemblance(F.col("print"), F.col("edited_print"), k).alias("near_edited"),
        resemblance(F.col("print"), F.col("next_print"), k).alias("near_next"),
        distinct_shingles(F.col("print"), k).alias("n_shingles_estimate"),
        containment(F.col("edited_print"), F.col("print"), k).alias("edited_contained"),
    )

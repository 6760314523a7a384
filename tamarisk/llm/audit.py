"""What each filter of a chain removes, in every order of the filters, from one pass over the documents.

A document is a *mask*: a bit for each filter that it fails. Per part and label the corpus is
summed up by 32 signed parity sums, one for each set S of filters: +1 for a document that
fails an even number of S and -1 for an odd one. These are the Walsh-Hadamard transform of
the masks' counts, so the inverse gives the exact count of every mask, and whatever is asked
about an order follows from the 32 counts of a part: no document is looked at again for
another order. Partial aggregation makes a part of any size a few rows a task.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.llm import words as W
from tamarisk.llm.linking import merged
from tamarisk.llm.store import Scratch

FILTERS = "ABCDE"
#: Sets of filters, and so parity sums and masks.
SETS = 1 << len(FILTERS)
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
SYMBOLS = r"[#$%&*|]"
#: By the number of filters that a document fails: in how many of all orders a certain one of them comes first.
FIRST_IN = (0, *(math.factorial(len(FILTERS)) // k for k in range(1, len(FILTERS) + 1)))


def _bit(condition: Column, letter: str) -> Column:
    return F.when(condition, 1 << FILTERS.index(letter)).otherwise(0)


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, key, mask) of every document by the filters that see one text: A, B, C and D; ``key`` is the text's sha256."""
    own = W.table(docs, "doc_id", "source", "text")
    own = own.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    n_words, distinct = F.size("words").cast("long"), F.size(F.array_distinct("words")).cast("long")
    capitals, points = F.regexp_count("text", F.lit("[A-Z]")).cast("long"), F.length("text").cast("long")
    mask = (
        _bit(n_words < LEAST_WORDS, "A")
        + _bit(100 * distinct < LEAST_DISTINCT * n_words, "B")
        + _bit(100 * capitals > MOST_CAPITALS * points, "C")
        + _bit(F.col("text").rlike(SYMBOLS), "D")
    )
    return own.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("key"), mask.alias("mask"))


def with_copies(marked: DataFrame) -> DataFrame:
    """``marked`` with E in the mask of each document whose text a smaller doc_id has, wherever in the table."""
    first = marked.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("key", "first")
    both = merged(marked, first, "key", "left")
    return both.select("doc_id", "part", (F.col("mask") + F.coalesce(_bit(F.col("doc_id") > F.col("first"), "E"), F.lit(0))).alias("mask"))


def labelled(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """``marked`` with ``good`` and ``toxic``: whether any label of the document says so."""
    own = W.table(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    own = own.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    return merged(marked, own, "doc_id", "left").select("part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def parity(mask: Column, of: Column) -> Column:
    """1 where ``mask`` has an even number of the bits of ``of``, else -1."""
    return (1 - 2 * (F.bit_count(mask.bitwiseAND(of)) % 2)).cast("long")


def parity_sums(marked: DataFrame) -> DataFrame:
    """(part, good, toxic, sums array<long>): the signed sums of all sets of filters, aggregated on the map side."""
    rows = marked.groupBy("part", "good", "toxic").agg(*(F.sum(parity(F.col("mask"), F.lit(s))).alias(f"s{s}") for s in range(SETS)))
    return rows.select("part", "good", "toxic", F.array(*(f"s{s}" for s in range(SETS))).alias("sums"))


def cells(sums: DataFrame) -> DataFrame:
    """(part, n, n_good, n_toxic): the counts of all 32 masks, by mask, all told and by label."""
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    # the transform is its own inverse but for the factor 32, by which every sum divides
    count = F.transform(F.sequence(F.lit(0), F.lit(SETS - 1)), lambda m: F.shiftright(total(F.transform("sums", lambda x, s: x * parity(m, s))), len(FILTERS)))
    rows = sums.withColumn("n", count)
    own = rows.select("part", "good", "toxic", F.posexplode("n").alias("mask", "n"))
    when = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    by_mask = own.groupBy("part", "mask").agg(F.sum("n").alias("n"), when("good").alias("n_good"), when("toxic").alias("n_toxic"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("mask", c))), lambda x: x[c]).alias(c)
    return by_mask.groupBy("part").agg(*(in_order(c) for c in ("n", "n_good", "n_toxic")))


def evaluated(by_part: DataFrame) -> DataFrame:
    """The rows of :func:`audit` from the counts of masks of each part."""
    masks = F.sequence(F.lit(0), F.lit(SETS - 1))

    def over(values: str, wanted) -> Column:
        return F.aggregate(F.filter(masks, wanted), F.lit(0).cast("long"), lambda a, m: a + F.get(F.col(values), m))

    orders = ["".join(p) for p in itertools.permutations(FILTERS)]
    rows = by_part.select("*", F.explode(F.array(*map(F.lit, orders))).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit_of = lambda k: f"shiftleft(1, locate(substr(filter_order, {k}, 1), '{FILTERS}') - 1)"
    earlier = f"aggregate(filter(sequence(1, {len(FILTERS)}), k -> k < step), 0, (a, k) -> a | {bit_of('k')})"
    rows = rows.withColumn("bit", F.expr(bit_of("step"))).withColumn("before", F.expr(earlier))
    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    reached = lambda m: m.bitwiseAND(F.col("before")) == 0
    here = lambda m: fails(m) & reached(m)
    share = F.aggregate(F.filter(masks, fails), F.lit(0).cast("long"), lambda a, m: a + F.get(F.col("n"), m) * F.get(F.array(*map(F.lit, FIRST_IN)), F.bit_count(m)))
    return rows.select(
        "part", "filter_order", "step",
        over("n", lambda m: m.bitwiseAND(F.col("before").bitwiseOR(F.col("bit"))) == 0).alias("kept"),
        over("n", here).alias("removed"),
        over("n", lambda m: fails(m) & ~reached(m)).alias("redundant"),
        over("n", lambda m: m == F.col("bit")).alias("unique_fails"),
        over("n_good", here).alias("good_lost"),
        over("n_toxic", here).alias("toxic_lost"),
        share.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``docs`` has doc_id, source and text, ``labels`` doc_id, quality and toxic; other columns are
    not read, whatever their names. Null text is empty and equals other empty ones, null source is
    the part of the empty string. A null doc_id is smaller than none and greater than none, so it is
    never a later copy, and has no label; rows that share doc_id and text are counted each and are no
    copies of each other. Of several labels of a document one that says so is enough; null says nothing.
    An empty table has no parts and gives no rows. Very long texts are read whole.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    # the texts are read once; what is joined afterwards is a few dozen bytes a document
    marked = scratch.put(failures(docs), "failures")
    sums = scratch.put(parity_sums(labelled(with_copies(marked), labels)), "sums")
    scratch.drop(marked)
    return evaluated(cells(sums))


def oracle_sql() -> str:
    """The same rows in DuckDB, by the masks' counts and the sum over all orders."""
    letters = " ".join(f"JOIN l AS x{i} ON " + " AND ".join(f"x{i}.letter <> x{j}.letter" for j in range(i)) for i in range(1, len(FILTERS)))
    order = " || ".join(f"x{i}.letter" for i in range(len(FILTERS)))
    steps = " UNION ALL ".join(f"SELECT filter_order, {k + 1} AS step, substr(filter_order, {k + 1}, 1) AS letter, {' + '.join([f'x{j}' for j in range(k)] or ['0'])} AS before, x{k} AS bit FROM o" for k in range(len(FILTERS)))
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
f AS (SELECT doc_id, part,
        CASE WHEN len(words) < {LEAST_WORDS} THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(words)) < {LEAST_DISTINCT} * len(words) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(text) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(text, '{SYMBOLS}') THEN 8 ELSE 0 END
        + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
      FROM w),
m AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic
      FROM f LEFT JOIN m ON f.doc_id = m.doc_id GROUP BY part, mask),
l AS (SELECT * FROM (VALUES {", ".join(f"('{x}', {1 << i})" for i, x in enumerate(FILTERS))}) AS t(letter, bit)),
o AS (SELECT {order} AS filter_order, {", ".join(f"x{i}.bit AS x{i}" for i in range(len(FILTERS)))} FROM l AS x0 {letters}),
s AS ({steps}),
e AS (SELECT part, filter_order, step, letter,
        sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n_good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n_toxic ELSE 0 END) AS toxic_lost
      FROM c CROSS JOIN s GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM e"""

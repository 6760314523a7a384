"""Exact connected components of a similarity graph that is only known by its buckets.

Two items can only be linked if they share a bucket. All pairs of a bucket grow with its
square, so pairs are left out in three ways, none of which loses a link between components:

1. *Centre.* The most central item of each bucket, the one that shares most buckets' members,
   is tested against the others: what all copies were made from comes before the copies.
2. *Components.* Afterwards only items of different components are tested. In a bucket, items
   outside the centre's component meet the others; a bucket of one component is done.
3. *Parity maps.* Each item carries a few longs in which every element of its set flips one
   bit. Elements that two items don't share are at least as many as the bits in which
   their maps differ, so a pair with too many is no link, whatever the sets hold. The join
   itself applies this, and pairs that fail it are never made.

Everything is joins and partial aggregations of DataFrames; nothing reaches the driver but
counts. Joins on buckets read written tables through Spark's own exchanges, so AQE splits
their hot keys. Merge joins are asked for: one strategy, and one growth, at every size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.llm.store import Scratch

#: 64-bit words of the Bloom filter of :func:`sifted`; its table has at most so many rows.
FILTER_WORDS = 1 << 17


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    return left.join(right.hint("merge"), on, how)


def spread(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of all ends of links (a, b): the smallest id that is reachable.

    Labels move along links and then jump to their own label's label, so chains halve
    with every step. Each step is two joins and partial aggregations.
    """
    both = scratch.put(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    labels = scratch.put(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, labels.id == near.a).select("id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        top = labels.select(F.col("id").alias("top_id"), F.col("component").alias("top"))
        jump = step.join(top, step.component == top.top_id, "left").select("id", "old", F.least("component", F.coalesce("top", "component")).alias("component"))
        following = scratch.put(jump, "labels")
        moved = following.where("component < old").limit(1).count()
        scratch.drop(labels)
        labels = scratch.same(following, following.select("id", "component"))
        if not moved:
            scratch.drop(both)
            return labels


def differing(x: str, y: str, words: int) -> Column:
    """In how many bits two parity maps of so many longs differ (columns of structs, fields b0, b1, ...)."""
    out = F.lit(0)
    for i in range(words):
        out = out + F.bit_count(F.col(f"{x}.b{i}").bitwiseXOR(F.col(f"{y}.b{i}")))
    return out


def components(
    members: DataFrame, features: DataFrame, may_link: Callable[[str, str], Column], verify: Callable[[DataFrame], DataFrame], scratch: Scratch,
    near: Callable[[str, str], Column] | None = None,
) -> tuple[DataFrame | None, DataFrame | None]:
    """((id, component) of linked items, links (a, b) that were found) of members (bucket, id long, pivot boolean).

    ``features``: (id, f) of every member, ``may_link`` a necessary condition on two of them
    (names of struct columns), ``near`` a dearer one for the pairs without a centre. Two items that are both no pivot of a bucket don't meet there.
    ``verify`` keeps of pairs (a, b), a < b, those that are linked. None where nothing is.
    A bucket holds an item once.
    """
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"))
    weights = merged(members, sizes, "bucket").groupBy("id").agg(F.sum("size").alias("weight"))
    weighed = scratch.put(merged(members, weights, "id"), "members")
    centres = weighed.groupBy("bucket").agg(F.max(F.struct("pivot", "weight", "id")).alias("c")).select("bucket", F.col("c.id").alias("centre"), F.col("c.pivot").alias("by_pivot"))
    centres = scratch.put(centres, "centres")
    met = merged(weighed, centres, "bucket").where("id != centre AND (pivot OR by_pivot)")
    pairs = met.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    first, second = features.select(F.col("id").alias("a"), F.col("f").alias("x")), features.select(F.col("id").alias("b"), F.col("f").alias("y"))
    pairs = scratch.put(merged(merged(pairs, first, "a"), second, "b").where(may_link("x", "y")).select("a", "b"), "pairs")
    links = scratch.put(verify(pairs), "links")
    scratch.drop(pairs)
    labels = spread(links, scratch) if links.limit(1).count() else None

    now = weighed.drop("weight")
    now = now.withColumn("component", F.col("id")) if labels is None else merged(now, labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    now = scratch.put(now, "now")
    scratch.drop(weighed)
    at = F.struct((F.col("id") == F.col("centre")).alias("is"), "component")
    open_ = merged(now, centres, "bucket").groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(at).alias("c"), F.min("centre").alias("centre"))
    open_ = open_.where("lo != hi").select("bucket", "centre", F.col("c.component").alias("main"))
    rest = scratch.put(merged(merged(now, open_, "bucket"), features, "id"), "open")
    scratch.drop(now, centres)
    x = rest.where("id != centre").select("bucket", F.col("id").alias("x_id"), F.col("component").alias("x_component"), (F.col("component") == F.col("main")).alias("x_main"), F.col("pivot").alias("x_pivot"), F.col("f").alias("x"))
    y = rest.where("id != centre AND component != main").select("bucket", F.col("id").alias("y_id"), F.col("component").alias("y_component"), F.col("pivot").alias("y_pivot"), F.col("f").alias("y"))
    meet = (x.bucket == y.bucket) & (F.col("x_component") != F.col("y_component")) & (F.col("x_main") | (F.col("x_id") < F.col("y_id"))) & (F.col("x_pivot") | F.col("y_pivot")) & may_link("x", "y")
    meet = meet if near is None else meet & near("x", "y")
    pairs = scratch.put(merged(x, y, meet).select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct(), "pairs")
    scratch.drop(rest)
    if not pairs.limit(1).count():
        scratch.drop(pairs)
        return labels, links if labels is not None else None
    more = scratch.put(verify(pairs), "links")
    scratch.drop(pairs)
    if not more.limit(1).count():
        scratch.drop(more)
        return labels, links if labels is not None else None
    every = scratch.put(links.union(more), "links")
    scratch.drop(links, more, labels)
    return spread(every, scratch), every


def sifted(rows: DataFrame, key: str, wanted: DataFrame, how: str = "left_semi", on: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` joined with the ``wanted`` ones by ``key``, a long that both have, or by several columns with it.

    A Bloom filter of ``FILTER_WORDS`` rows at most, joined by broadcast, keeps most others out
    of the shuffle; where it is full all rows take part in it, and the result is the same.
    """
    word = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_WORDS))
    bit = lambda c: F.shiftrightunsigned(F.xxhash64(c), 40).bitwiseAND(63).cast("int")
    table = wanted.select(word(key).alias("_word"), bit(key).alias("_bit")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    names = rows.columns
    maybe = rows.withColumn("_word", word(key)).withColumn("_bit", bit(key)).join(F.broadcast(table), "_word").where("getbit(_bits, _bit) = 1")
    return merged(maybe.select(*(F.col(f"`{n}`") for n in names)), wanted, list(on or (key,)), how)

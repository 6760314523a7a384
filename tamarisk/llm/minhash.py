"""Near-duplicate documents by min-max hashing.

Each permutation gives two signature values, the least and the greatest hash of the
set, so half as many hash evaluations make a signature of the same length (each value
agrees with probability equal to the resemblance; least and greatest are less
correlated than two draws of one, which lowers the variance). Bands of four values,
two least and two greatest of different permutations, propose candidates; candidates
are confirmed on the full shingle sets, and :mod:`linking` finds the components.

Of pairs that meet in a bucket only those are confirmed whose parity maps (1024 bits, one
flipped by each shingle) leave the resemblance possible.

With 32 bands of 4 values a pair at the threshold of 0.75 shares no band with
probability (1 - 0.75**4) ** 32 = 5e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm import words as W
from tamarisk.llm.linking import components, differing, merged, sifted
from tamarisk.llm.store import Scratch

WIDTH = 5
NUMERATOR, DENOMINATOR = 75, 100
PERMUTATIONS = 64
ROWS = 4
#: Longs of a parity map.
MAP = 16
SIGNED = "doc_id long, text_hash long, n_shingles long, set_1 long, set_2 long, bands array<long>"
SETS = "id long, n long, " + ", ".join(f"b{i} long" for i in range(MAP)) + ", shingles binary"


def shingle_sets(array: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(flat sorted distinct shingle hashes, starts): one set a document.

    Words are lower-cased (A-Z); with fewer than ``width`` words the whole sequence is the
    only shingle; without words the set is empty.
    """
    words = W.Words(array, lower=True)
    flat = words.hashes()[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    whole = W.windows(flat, width)
    sets = []
    for a, b in zip(words.starts[:-1].tolist(), words.starts[1:].tolist(), strict=True):
        n = b - a
        if n >= width:
            own = np.sort(whole[a : b - width + 1])
            sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        else:
            sets.append(W.mix(W.windows(flat[a:b], n) + np.uint64(n)) if n else whole[:0])
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else flat), np.concatenate([[0], np.cumsum(sizes)])


def signatures(flat: np.ndarray, starts: np.ndarray, permutations: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) hashes of each non-empty set, a row a set and a column a permutation."""
    draw = np.random.Generator(np.random.PCG64(20240229))
    factor = draw.integers(0, 1 << 63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = draw.integers(0, 1 << 63, permutations, dtype=np.uint64)
    begin = starts[:-1]
    least, most = np.zeros((len(begin), permutations), np.uint64), np.zeros((len(begin), permutations), np.uint64)
    for i in range(permutations):
        x = flat * factor[i] + shift[i]
        x ^= x >> np.uint64(32)
        least[:, i] = np.minimum.reduceat(x, begin)
        most[:, i] = np.maximum.reduceat(x, begin)
    return least, most


def band_keys(least: np.ndarray, most: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band: half of its values least, half greatest, each of another permutation."""
    permutations, half = least.shape[1], rows // 2
    bands = 2 * permutations // rows
    out = np.zeros((len(least), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(least), b + 1, np.uint64)
        for j in range(half):
            key = W.mix(key * np.uint64(0x9E3779B97F4A7C15) + least[:, (b * half + j) % permutations])
            key = W.mix(key * np.uint64(0x9E3779B97F4A7C15) + most[:, (b * half + j + permutations // 2) % permutations])
        out[:, b] = key
    return out


def digests(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over each set, which name it; zeros for an empty set."""
    out = np.zeros((2, len(starts) - 1), np.uint64)
    full = np.flatnonzero(np.diff(starts))
    for i, salt in enumerate((0x1234567, 0x89ABCDEF)):
        if len(full):
            out[i, full] = np.add.reduceat(W.mix(flat ^ np.uint64(salt)), starts[:-1][full])
    return out


def parity_maps(flat: np.ndarray, starts: np.ndarray, words: int = MAP, block: int = 1000) -> np.ndarray:
    """A row of longs a set, in which each element has flipped one bit; ``block`` sets at once bound the memory."""
    bits, n = 64 * words, len(starts) - 1
    out = np.zeros((n, words), np.uint64)
    for a in range(0, n, block):
        b = min(n, a + block)
        spot = (W.mix(flat[starts[a] : starts[b]]) % np.uint64(bits)).astype(np.int64) + np.repeat(np.arange(b - a), np.diff(starts[a : b + 1])) * bits
        odd = (np.bincount(spot, minlength=(b - a) * bits) & 1).astype(np.uint8)
        out[a:b] = np.packbits(odd, bitorder="little").view("<u8").reshape(-1, words)
    return out


def sign(docs: DataFrame, width: int = WIDTH, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """(doc_id, hash of the text, n_shingles, 128-bit digest of the set, band keys or null for an empty set)."""
    W.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in W.chunks(batches):
            flat, starts = shingle_sets(W.texts(chunk["text"]), width)
            sizes = np.diff(starts)
            full = np.flatnonzero(sizes)
            keys = np.zeros((0, 2 * permutations // rows), np.uint64)
            if len(full):
                keys = band_keys(*signatures(flat, np.append(starts[:-1][full], len(flat)), permutations), rows)
            digest = digests(flat, starts)
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes > 0) * keys.shape[1]]), pa.int32()), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [chunk["doc_id"].combine_chunks(), chunk["text_hash"].combine_chunks(), pa.array(sizes), *(pa.array(d.view(np.int64)) for d in digest), bands], names=["doc_id", "text_hash", "n_shingles", "set_1", "set_2", "bands"]
            )

    own = W.table(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, SIGNED)


def sets_of(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """Size, parity map and sorted little-endian 64-bit hashes of each whole set whose digest is the one named beside (id, text, set_1, set_2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in W.chunks(batches):
            flat, starts = shingle_sets(W.texts(chunk["text"]), width)
            right = np.all([x.view(np.int64) == chunk[c].to_numpy() for x, c in zip(digests(flat, starts), ("set_1", "set_2"), strict=True)], axis=0)
            raw = [flat[a:b].astype("<u8").tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            longs = [chunk["id"].to_numpy(), np.diff(starts), *parity_maps(flat, starts).T]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in longs), pa.array(raw, pa.binary())], names=[c.split(" ")[0] for c in SETS.split(", ")]).filter(pa.array(right))

    return texts.select("id", "text", "set_1", "set_2").mapInArrow(run, SETS)


def confirm(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.sort(np.concatenate([p, q]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(denominator * common >= numerator * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    second = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return merged(merged(pairs, first, "a"), second, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = WIDTH, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) of every row of ``docs``.

    Null or empty text: an empty set, linked with nothing. Documents with equal sets are one
    item until the end, however many they are. Rows of one doc_id with different texts are
    items of their own; equal rows repeat in the result. Rows with a null doc_id are never
    linked (component null, kept). ``text_hash`` (xxhash64) tells rows of one doc_id apart.
    An empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    signed = scratch.put(sign(docs, width), "signed")
    own = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    groups = own.groupBy("set_1", "set_2").agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands"))
    # numbered as they are written, so the numbers are unique and stay
    groups = scratch.put(groups.withColumn("id", F.monotonically_increasing_id()), "groups")
    banded = groups.select(F.explode("bands").alias("bucket"), "id")
    shared = banded.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("bucket")
    members = scratch.put(merged(banded, shared, "bucket").select("bucket", "id", F.lit(True).alias("pivot")), "members")
    labels = None
    if members.limit(1).count():
        wanted = merged(groups.select("id", "first", "set_1", "set_2"), members.select("id").distinct(), "id", "left_semi")
        wanted = scratch.put(wanted, "wanted")
        W.small_batches(spark)
        texts = W.table(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        texts = sifted(texts, "doc_id", wanted.withColumnRenamed("first", "doc_id"), "inner")
        # equal rows once; they lie in one partition already
        texts = texts.withColumn("text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "id", "text_hash"])
        sets = scratch.put(sets_of(texts, width), "sets")

        def may_link(x: str, y: str):
            """Of n + m elements at least as many as the maps differ in are not shared: is what is left enough?"""
            both = F.col(f"{x}.n") + F.col(f"{y}.n")
            common = (both - differing(x, y, MAP)) / 2
            large = F.least(F.col(f"{x}.n"), F.col(f"{y}.n")) * denominator >= F.greatest(F.col(f"{x}.n"), F.col(f"{y}.n")) * numerator
            return large & (common * denominator >= (both - common) * numerator)

        features = sets.select("id", F.struct("n", *(f"b{i}" for i in range(MAP))).alias("f"))
        labels, links = components(members, features, may_link, lambda pairs: confirm(pairs, sets, numerator, denominator), scratch)
        scratch.drop(sets, wanted, links)
    scratch.drop(members)
    roots = groups.select("id", "set_1", "set_2", "first")
    if labels is not None:
        linked = merged(roots, labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        least = linked.groupBy("component").agg(F.min("first").alias("root"))
        roots = merged(linked, least, "component").select("set_1", "set_2", "root")
    else:
        roots = roots.select("set_1", "set_2", F.col("first").alias("root"))
    # the many documents without words don't meet under one key
    some = F.col("n_shingles") > 0
    keyed = signed.drop("bands").withColumn("set_1", F.when(some, F.col("set_1")).otherwise(F.xxhash64("doc_id"))).withColumn("set_2", F.when(some, F.col("set_2")))
    out = merged(keyed, roots, ["set_1", "set_2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(some, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), "text_hash")

"""Interpolated modified Kneser-Ney bigram model, counted in Spark, mapped by the workers.

Training is three passes of one shape: tasks count their documents' n-grams in numpy and
send each bucket one sorted blob; the bucket's task merges the blobs and writes one sorted
array into the shared folder. The driver only sees a few numbers a bucket.

1. words: sorted 64-bit word hashes and counts. A word's id is its place in that order.
2. bigrams: sorted ``context id << 32 | word id`` keys and counts. A bucket holds all bigrams
   of its contexts; the contexts with more than ``1 / HOT`` of all tokens (so at most ``HOT``
   of them) are split over the buckets by the following word.
3. per word: how many continuations its bigrams have once, twice, more often, and how many
   distinct contexts precede it.

Scoring maps the arrays (``numpy.memmap``), so all workers of a machine share their pages,
and looks up each chunk's *distinct* words and bigrams once, in sorted order. The model's
size follows the corpus; nothing of it is broadcast or collected.

p(w | v) = max(c(v w) - D(c), 0) / c(v) + g(v) * q(w), and q(w) the same over continuation
counts, with the uniform distribution over the vocabulary and one unknown word below it.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm import words as W
from tamarisk.llm.store import Scratch

#: Hashes that no word has: words contain no white space.
END, BEGIN = "\n</s>", "\n<s>"
#: A context with more than this part of all tokens is split over the buckets.
HOT = 1000
BLOB = "bucket long, blob binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def _special(text: str) -> np.uint64:
    return W.hash_strings(pa.array([text]))[0]


def remainder(doc_ids: pa.ChunkedArray) -> np.ndarray:
    """crc32 of each doc_id as text, modulo 10; a null id counts as the empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 10 for i in doc_ids.to_pylist()], np.int64)


def folder(spark, scratch: Scratch) -> str:
    """The scratch folder as a path that workers can map files from."""
    root = scratch.root
    if "://" in root or root.startswith("file:"):
        scheme, _, rest = root.partition(":")
        if scheme != "file":
            raise ValueError(f"the model's arrays are memory-mapped: spark.checkpoint.dir must be a folder mounted on all machines, not {scheme}:")
        root = "/" + rest.lstrip("/")
    return root


def bucket_count(parts: int) -> int:
    """A power of two, four times the partitions of a shuffle: more data needs more partitions, and so gets more buckets."""
    return 1 << min(16, (4 * parts - 1).bit_length())


def save(path: str, array: np.ndarray) -> None:
    """Written under another name and renamed: a retried or speculative task replaces it by the same."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{os.getpid()}.{np.random.default_rng().integers(1 << 62)}"
    with open(own, "wb") as f:
        f.write(np.ascontiguousarray(array).tobytes())
    os.replace(own, path)


def load(path: str, dtype, n: int) -> np.ndarray:
    """The ``n`` values that were written there; an error if they are not all there, as an empty array would silently change results."""
    if not n:
        return np.zeros(0, dtype)
    found = np.memmap(path, dtype, "r")
    if len(found) != n:
        raise OSError(f"{path} holds {len(found)} values of {n}")
    return found


def packed(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Sorted keys as differences, and values beside, byte by byte (the upper bytes are nearly all zero), compressed."""
    import zstandard

    planes = lambda x: np.ascontiguousarray(x).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    raw = planes(np.diff(keys, prepend=np.uint64(0))) + b"".join(planes(v) for v in values)
    return np.int64(len(keys)).tobytes() + zstandard.ZstdCompressor(level=1).compress(raw)


def unpacked(blob: bytes, values: int) -> tuple[np.ndarray, ...]:
    import zstandard

    n = int(np.frombuffer(blob[:8], np.int64)[0])
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:], max_output_size=8 * n * (1 + values) + 64), np.uint8)
    gaps, *found = (np.ascontiguousarray(raw[8 * n * i : 8 * n * (i + 1)].reshape(8, n).T).view("<u8").ravel() for i in range(1 + values))
    return np.cumsum(gaps, dtype=np.uint64), *(v.view("<i8") for v in found)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct sorted keys with their values' sums."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], *(np.add.reduceat(v[order].astype(np.int64), first) for v in values)


def dealt(bucket: np.ndarray, keys: np.ndarray, *values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) of sorted keys dealt to buckets."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    starts = W.run_starts(bucket)
    for a, b in zip(starts, np.append(starts[1:], len(bucket)), strict=True) if len(starts) else ():
        take = order[a:b]
        yield int(bucket[a]), packed(keys[take], *(v[take] for v in values))


def blobs(found: Iterator[tuple[int, bytes]], rows: int = 256) -> Iterator[pa.RecordBatch]:
    held = []
    for pair in found:
        held.append(pair)
        if len(held) == rows:
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in held], pa.int64()), pa.array([x for _, x in held], pa.binary())], names=["bucket", "blob"])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in held], pa.int64()), pa.array([x for _, x in held], pa.binary())], names=["bucket", "blob"])


def merged(batches: Iterator[pa.RecordBatch], values: int) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """(bucket, summed arrays) of a task's blobs, which come sorted by bucket."""
    bucket, held = None, []

    def done():
        parts = [unpacked(x, values) for x in held]
        return bucket, summed(*(np.concatenate(c) for c in zip(*parts, strict=True)))

    for batch in batches:
        for b, x in zip(batch["bucket"].to_pylist(), batch["blob"].to_pylist(), strict=True):
            if b != bucket and held:
                yield done()
                held = []
            bucket = b
            held.append(x)
    if held:
        yield done()


class Model:
    """Where a trained model's arrays lie, its few global numbers, and look-ups in it."""

    def __init__(self, root: str, buckets: int):
        self.root, self.buckets, self.bits = root, buckets, buckets.bit_length() - 1
        #: What was written: words and bigrams of each bucket.
        self.sizes, self.pairs = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        self.offsets = np.zeros(buckets + 1, np.int64)
        self.n = self.v = self.types = 0
        self.discounts = self.low_discounts = np.zeros(4)
        self.low_gamma = 1.0
        self.hot: np.ndarray = np.zeros(0, np.int64)
        self.end = self.begin = -1

    def word_bucket(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of words by hash, -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        for b, (x, y) in self._runs(self.word_bucket(ranked)):
            there = load(f"{self.root}/words/{b}.hash", np.uint64, self.sizes[b])
            if len(there):
                at = np.minimum(np.searchsorted(there, ranked[x:y]), len(there) - 1)
                out[order[x:y]] = np.where(there[at] == ranked[x:y], at + self.offsets[b], -1)
        return out

    @staticmethod
    def _runs(sorted_buckets: np.ndarray) -> Iterator[tuple[int, tuple[int, int]]]:
        if len(sorted_buckets):
            starts = np.flatnonzero(np.concatenate([[True], sorted_buckets[1:] != sorted_buckets[:-1]]))
            yield from zip(sorted_buckets[starts].tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(sorted_buckets)], strict=True), strict=True)

    def of_words(self, ids: np.ndarray, name: str, dtype, width: int = 1) -> np.ndarray:
        """A per-word array's rows at sorted ids."""
        out = np.zeros((len(ids), width), np.int64)
        for b, (x, y) in self._runs(np.searchsorted(self.offsets, ids, side="right") - 1):
            out[x:y] = load(f"{self.root}/words/{b}.{name}", dtype, self.sizes[b] * width).reshape(-1, width)[ids[x:y] - self.offsets[b]]
        return out

    def bigram_bucket(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        at = W.mix(context.astype(np.uint64))
        if len(self.hot):
            spread = np.isin(context, self.hot)
            at = np.where(spread, W.mix(at + word.astype(np.uint64)), at)
        return (at >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(at), np.int64)

    def bigram_counts(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        keys = (context.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64)
        bucket = self.bigram_bucket(context, word)
        order = np.lexsort((keys, bucket))
        ranked, out = keys[order], np.zeros(len(keys), np.int64)
        for b, (x, y) in self._runs(bucket[order]):
            there = load(f"{self.root}/bigrams/{b}.key", np.uint64, self.pairs[b])
            if len(there):
                at = np.minimum(np.searchsorted(there, ranked[x:y]), len(there) - 1)
                count = load(f"{self.root}/bigrams/{b}.count", np.int64, self.pairs[b])[at]
                out[order[x:y]] = np.where(there[at] == ranked[x:y], count, 0)
        return out

    def low(self, continuations: np.ndarray) -> np.ndarray:
        """q of words with so many distinct contexts."""
        if not self.types:
            return np.full(len(continuations), 1.0 / (self.v + 1))
        kept = np.maximum(continuations - self.low_discounts[np.minimum(continuations, 3)], 0)
        return kept / self.types + self.low_gamma / (self.v + 1)


def discounts(of: np.ndarray) -> np.ndarray:
    """D by count (0, 1, 2, 3 and more) from the numbers of n-grams that occur once to four times."""
    n1, n2, n3, n4 = (float(x) for x in of)
    if not n1 or not n2:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(x, 0.0), float(i)) for i, x in enumerate(d, 1))])


def counts_of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()


def tokens(chunk: pa.Table) -> tuple[W.Words, np.ndarray]:
    """Words of a chunk and the hashes of its distinct words."""
    words = W.Words(W.texts(chunk["text"]), lower=True)
    return words, words.hashes()


def bigrams(words: W.Words, ids: np.ndarray, begin: int, end: int, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context ids, word ids, document) of the kept documents, each with its begin and end."""
    which = np.flatnonzero(keep)
    counts = words.counts[which]
    flat = ids[words.codes[W.ragged(words.starts[:-1][which], counts)]] if len(words.codes) else np.zeros(0, np.int64)
    ends = np.cumsum(counts + 1)
    word = np.full(int(counts.sum()) + len(which), end, np.int64)
    inner = np.ones(len(word), bool)
    inner[ends - 1] = False
    word[inner] = flat
    context = np.concatenate([[begin], word[:-1]]) if len(word) else word
    context[ends - counts - 1] = begin
    return context, word, np.repeat(which, counts + 1)


def train(docs: DataFrame, scratch: Scratch) -> Model:
    """Counts over all of ``docs`` (doc_id, text) whose crc32 remainder is not 0."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = bucket_count(parts)
    root = folder(spark, scratch)
    model = Model(root, buckets)
    end, begin = _special(END), _special(BEGIN)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for chunk in W.chunks(batches):
            keep = remainder(chunk["doc_id"]) != 0
            words, hashes = tokens(chunk)
            n = np.bincount(words.codes[np.repeat(keep, words.counts)], minlength=len(hashes))
            held.append(summed(np.concatenate([hashes[n > 0], [end, begin]]), np.concatenate([n[n > 0], [keep.sum()] * 2])))
        if held:
            keys, n = summed(*(np.concatenate(c) for c in zip(*held, strict=True)))
            yield from blobs(dealt(model.word_bucket(keys), keys, n))

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (keys, n) in merged(batches, 1):
            keys, n = keys[n > 0], n[n > 0]
            save(f"{root}/words/{bucket}.hash", keys)
            save(f"{root}/words/{bucket}.count", n.astype(np.int64))
            real = keys != begin
            yield pa.RecordBatch.from_pylist([{"bucket": bucket, "size": len(keys), "n": int(n[real].sum())}])

    def by_bucket(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "bucket").sortWithinPartitions("bucket")

    told = by_bucket(docs.mapInArrow(count_words, BLOB)).mapInArrow(write_words, "bucket long, size long, n long").collect()
    for row in told:
        model.sizes[row.bucket] = row.size
    model.offsets = np.concatenate([[0], np.cumsum(model.sizes)])
    model.n = sum(row.n for row in told)
    model.begin, model.end = (int(x) for x in model.ids(np.array([begin, end], np.uint64)))
    model.v = int(model.sizes.sum()) - (model.begin >= 0)
    if model.sizes.sum() >= 1 << 32:
        raise OverflowError("word ids take 32 bits of a bigram's key")
    least = max(1, model.n // HOT)

    def hot_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket in batch["id"].to_pylist():
                n = load(f"{root}/words/{bucket}.count", np.int64, model.sizes[bucket])
                yield pa.RecordBatch.from_pylist([{"id": int(i) + int(model.offsets[bucket])} for i in np.flatnonzero(n > least)], pa.schema([("id", pa.int64())]))

    # at most HOT words can each have more than 1 / HOT of all tokens
    model.hot = np.sort(np.array([r.id for r in spark.range(0, buckets, 1, min(buckets, 8)).mapInArrow(hot_words, "id long").collect()], np.int64))

    def count_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for chunk in W.chunks(batches):
            words, hashes = tokens(chunk)
            context, word, _ = bigrams(words, model.ids(hashes), model.begin, model.end, remainder(chunk["doc_id"]) != 0)
            held.append(summed((context.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64), np.ones(len(word), np.int64)))
        if held:
            keys, n = summed(*(np.concatenate(c) for c in zip(*held, strict=True)))
            yield from blobs(dealt(model.bigram_bucket(keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)), keys, n))

    def write_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = np.zeros(4, np.int64)
        held = []
        for bucket, (keys, n) in merged(batches, 1):
            save(f"{root}/bigrams/{bucket}.key", keys)
            save(f"{root}/bigrams/{bucket}.count", n.astype(np.int64))
            of += counts_of_counts(n)
            yield from blobs([(-2, np.array([bucket, len(keys)], np.int64).tobytes())])
            context, word = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
            one, zero = np.ones(len(keys), np.int64), np.zeros(len(keys), np.int64)
            follow = summed(context, n == 1, n == 2, n > 2)
            precede = summed(word, one)
            held.append(summed(np.concatenate([follow[0], precede[0]]), *(np.concatenate([f, zero[: len(precede[0])]]) for f in follow[1:]), np.concatenate([zero[: len(follow[0])] if len(follow[0]) <= len(zero) else np.zeros(len(follow[0]), np.int64), precede[1]])))
        yield from blobs([(-1, of.tobytes())])
        if held:
            keys, *values = summed(*(np.concatenate(c) for c in zip(*held, strict=True)))
            yield from blobs(dealt(np.searchsorted(model.offsets, keys.astype(np.int64), side="right") - 1, keys, *values))

    stats = scratch.put(by_bucket(docs.mapInArrow(count_bigrams, BLOB)).mapInArrow(write_bigrams, BLOB), "stats")
    model.discounts = discounts(sum((np.frombuffer(r.blob, np.int64) for r in stats.where("bucket = -1").collect()), np.zeros(4, np.int64)))
    for r in stats.where("bucket = -2").collect():
        bucket, n = np.frombuffer(r.blob, np.int64)
        model.pairs[bucket] = n

    def write_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (keys, *values) in merged(batches, 4):
            table = np.zeros((model.sizes[bucket], 4), np.int64)
            table[keys.astype(np.int64) - model.offsets[bucket]] = np.stack(values, 1)
            save(f"{root}/words/{bucket}.stats", table)
            yield pa.RecordBatch.from_pylist([{"types": int(table[:, 3].sum()), "of": counts_of_counts(table[:, 3]), "more": int((table[:, 3] > 2).sum())}], pa.schema([("types", pa.int64()), ("of", pa.list_(pa.int64())), ("more", pa.int64())]))

    # the bucket's blobs come from few tasks: small, and already summed by task
    low = by_bucket(stats.where("bucket >= 0")).mapInArrow(write_stats, "types long, of array<long>, more long").collect()
    scratch.drop(stats)
    model.types = sum(r.types for r in low)
    of = sum((np.array(r.of) for r in low), np.zeros(4, np.int64))
    model.low_discounts = discounts(of)
    if model.types:
        model.low_gamma = float(np.dot(model.low_discounts[1:], [of[0], of[1], sum(r.more for r in low)])) / model.types
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in W.chunks(batches, W.CHUNK_BYTES // 2):
            words, hashes = tokens(chunk)
            n_docs = len(words.counts)
            ids = model.ids(hashes)
            known = np.unique(np.concatenate([ids[ids >= 0], [x for x in (model.end, model.begin) if x >= 0]])).astype(np.int64)
            count = model.of_words(known, "count", np.int64)[:, 0]
            stats = model.of_words(known, "stats", np.int64, 4)
            follow, precede = stats[:, :3], stats[:, 3]
            # a place for the unknown word at the end of the local arrays
            place = np.searchsorted(known, ids)
            place[ids < 0] = len(known)
            places = {x: int(np.searchsorted(known, x)) if x >= 0 else len(known) for x in (model.begin, model.end)}
            context, word, owner = bigrams(words, place, places[model.begin], places[model.end], np.ones(n_docs, bool))
            key, inverse = np.unique(context * (len(known) + 1) + word, return_inverse=True)
            v, w = key // (len(known) + 1), key % (len(known) + 1)
            both = (v < len(known)) & (w < len(known))
            c = np.zeros(len(key), np.int64)
            c[both] = model.bigram_counts(known[v[both]], known[w[both]])
            total = np.append(count, 0)
            q = np.append(model.low(precede), model.low(np.zeros(1, np.int64)))
            gamma = np.append(follow @ model.discounts[1:], 0.0)
            seen = np.maximum(total, 1)
            some = follow.sum(1) if len(follow) else np.zeros(0)
            has = np.append(some > 0, False)[v]
            p = np.where(has, np.maximum(c - model.discounts[np.minimum(c, 3)], 0) / seen[v] + gamma[v] / seen[v] * q[w], q[w])
            base = np.log10((total + 0.1) / (model.n + 0.1 * (model.v + 1)))
            n_tokens = words.counts + 1
            out = [np.bincount(owner, x, n_docs) for x in ((total > 0)[word], base[word], np.log10(p)[inverse])]
            columns = [chunk["doc_id"].combine_chunks(), remainder(chunk["doc_id"]) == 0, n_tokens, out[0].astype(np.int64), np.full(n_docs, model.n), out[1], out[2], 10.0 ** (-out[2] / n_tokens)]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=[x.split(" ")[0] for x in SCORED.split(", ")])

    return docs.mapInArrow(run, SCORED)


def perplexity(docs: DataFrame) -> DataFrame:
    """Train on the documents that are not held out, and score all.

    Null text counts as empty: its only token is the end. A null doc_id hashes as the empty
    text. Equal rows all count in training and get equal rows each. An empty table gives an
    empty result; with no training documents all words are unknown and equally likely.
    Other columns are not read.
    """
    W.small_batches(docs.sparkSession)
    docs = W.table(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return score(docs, train(docs, Scratch(docs.sparkSession, "ngrams")))

"""Removal of passages that a document shares with an earlier one.

A passage counts from ``LENGTH`` words on. Comparing every document with automata of
the whole corpus grows with the square of the corpus, so the reference is cut down and
sharded first:

1. *Anchors.* Of every 50-word window the least hash of its 16-word grams is its anchor:
   equal windows have equal anchors. Anchors that only one document has need no more work.
2. *Contexts.* Consecutive windows with one anchor make a context. The contexts of shared
   anchors are dealt by anchor to shards; equal ones meet as one with their first document.
3. *Automata.* A shard's task builds a suffix automaton over the contexts of each anchor
   that has different ones, every state knowing the first document it ends in, and streams
   the contexts through it: matching statistics tell which windows an earlier one holds.
4. *Removal.* The documents are read again; each context is looked up in the shard's sorted,
   memory-mapped arrays. A later copy of a context is removed whole, its first one by the
   automaton's answer; overlapping windows join into maximal spans.

The reference shards are dealt to tasks instead of broadcast: the corpus is its own
reference and has no size bound. An anchor that more than ``HOT`` documents have isn't
gathered in a task: its windows are compared by 128-bit hash in a partial aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm import words as W
from tamarisk.llm.ngrams import bucket_count, folder, load, save
from tamarisk.llm.store import Scratch

LENGTH, GRAM = 50, 16
#: Documents of one anchor that a task gathers at most.
HOT = 2048
#: Windows of a context; they fit one 64-bit mask.
LONGEST = 48
#: Words of one automaton.
AUTOMATON_WORDS = 1 << 16
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class SuffixAutomaton:
    """A generalised suffix automaton; each state knows the least document it ends in."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.doc = [-1], [0], [1 << 63]

    def _state(self, length: int, doc: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.len.append(length)
        self.doc.append(doc)
        return len(self.len) - 1

    def _clone(self, p: int, q: int, w: int) -> int:
        new = self._state(self.len[p] + 1, self.doc[q])
        self.next[new] = dict(self.next[q])
        self.link[new] = self.link[q]
        self.link[q] = new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def add(self, words: list[int], doc: int) -> None:
        last = 0
        for w in words:
            q = self.next[last].get(w)
            if q is not None:
                if self.len[q] != self.len[last] + 1:
                    q = self._clone(last, q, w)
                if doc < self.doc[q]:
                    self.doc[q] = doc
                last = q
                continue
            new = self._state(self.len[last] + 1, doc)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                self.link[new] = q if self.len[q] == self.len[p] + 1 else self._clone(p, q, w)
            last = new

    def close(self) -> None:
        """Pass documents down the suffix links: a suffix ends wherever its longer states end."""
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            p = self.link[s]
            if self.doc[s] < self.doc[p]:
                self.doc[p] = self.doc[s]

    def first_documents(self, words: list[int], length: int) -> list[int]:
        """For each window of ``length`` words the least document that holds it (2**63: none)."""
        state, matched, out = 0, 0, []
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.len[state]
            if w in self.next[state]:
                state = self.next[state][w]
                matched += 1
            while self.len[self.link[state]] >= length and state:
                state = self.link[state]
                matched = self.len[state]
            if i + 1 >= length:
                out.append(self.doc[state] if matched >= length else 1 << 63)
        return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, in log2(width) passes."""
    n, have = len(x) - width + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have : width - have + n])


class Contexts:
    """The contexts of a chunk: runs of windows of one document with one anchor."""

    def __init__(self, words: W.Words, hashes: np.ndarray, length: int = LENGTH, gram: int = GRAM):
        self.flat = hashes[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
        anchors = sliding_min(W.windows(self.flat, gram), length - gram + 1)
        per = np.maximum(words.counts - length + 1, 0)
        starts = W.ragged(words.starts[:-1], per)
        owner = np.repeat(np.arange(len(per)), per)
        anchors = anchors[starts] if len(starts) else np.zeros(0, np.uint64)
        new = np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])]) if len(starts) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(starts)))
        if (sizes > LONGEST).any():  # long runs of one anchor are cut
            cuts = (sizes + LONGEST - 1) // LONGEST
            offset = W.ragged(np.zeros(len(first), np.int64), cuts)
            first, sizes = np.repeat(first, cuts) + offset * LONGEST, np.minimum(np.repeat(sizes, cuts) - offset * LONGEST, LONGEST)
        # a minimum is small: mixed, so that its upper bits deal evenly
        self.anchor, self.document, self.start, self.n = W.mix(anchors[first]), owner[first], starts[first], sizes
        self.length = length

    def digests(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of each context's words."""
        if not len(which):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        counts = self.n[which] + self.length - 1
        own = self.flat[W.ragged(self.start[which], counts)]
        place = W.ragged(np.zeros(len(which), np.int64), counts).astype(np.uint64)
        at = np.cumsum(counts) - counts
        return tuple(np.add.reduceat(W.mix(own * np.uint64(2 * k + 1) + (place + np.uint64(1)) * np.uint64(m)), at) for k, m in ((3, 0x9E3779B97F4A7C15), (7, 0xC2B2AE3D27D4EB4F)))

    def window_digests(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window starts, two 64-bit hashes) of all windows of contexts."""
        starts = W.ragged(self.start[which], self.n[which])
        if not len(starts):
            return starts, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        one, two = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
        for i in range(self.length):
            x = self.flat[starts + i]
            one = one * np.uint64(0x9E3779B97F4A7C15) + x
            two = two * np.uint64(0xD6E8FEB86659FD93) + W.mix(x)
        return starts, W.mix(one), W.mix(two)


class Sorted:
    """Sorted key files of a folder, by the keys' upper bits."""

    def __init__(self, root: str, buckets: int):
        self.root, self.bits = root, buckets.bit_length() - 1
        #: How many keys each written bucket has.
        self.sizes: dict[int, int] = {}

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)

    def write(self, bucket: int, keys: np.ndarray, **values: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        save(f"{self.root}/{bucket}.key", keys[order].astype(np.uint64))
        for name, v in values.items():
            save(f"{self.root}/{bucket}.{name}", v[order])

    def find(self, keys: np.ndarray, buckets: np.ndarray, **values) -> tuple[np.ndarray, ...]:
        """(found, the named values at the keys): files are mapped, and read where keys fall."""
        order = np.lexsort((keys, buckets))
        ranked, where = keys[order], buckets[order]
        found = np.zeros(len(keys), bool)
        out = {n: np.zeros(len(keys), t) for n, t in values.items()}
        starts = W.run_starts(where)
        for a, b in zip(starts, np.append(starts[1:], len(where)), strict=True) if len(starts) else ():
            n_keys = self.sizes.get(int(where[a]), 0)
            if not n_keys:
                continue
            there = load(f"{self.root}/{where[a]}.key", np.uint64, n_keys)
            at = np.minimum(np.searchsorted(there, ranked[a:b]), len(there) - 1)
            found[order[a:b]] = there[at] == ranked[a:b]
            for n, t in values.items():
                out[n][order[a:b]] = load(f"{self.root}/{where[a]}.{n}", t, n_keys)[at]
        return found, *out.values()


WRITTEN = "bucket long, n long"


def _told(bucket: int, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"bucket": bucket, "n": n}], pa.schema([("bucket", pa.int64()), ("n", pa.int64())]))


def _write_rows(rows: DataFrame, target: Sorted, key: str, parts: int, **values) -> None:
    """Rows (key long, values) into sorted files, whose sizes ``target`` then knows: one number a bucket."""
    bucket = F.shiftrightunsigned(key, 64 - target.bits) if target.bits else F.lit(0).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches([*batches] or [pa.RecordBatch.from_pylist([], _schema(["bucket", key, *values]))])
        if held.num_rows:
            column = {c: held[c].to_numpy() for c in held.column_names}
            for b in np.unique(column["bucket"]).tolist():
                own = column["bucket"] == b
                target.write(b, column[key][own].view(np.uint64), **{c: column[c][own].astype(t) for c, t in values.items()})
                yield _told(b, int(own.sum()))

    told = rows.withColumn("bucket", bucket).select("bucket", key, *values).repartition(parts, "bucket").mapInArrow(run, WRITTEN)
    target.sizes = {r.bucket: r.n for r in told.collect()}


def _schema(names: list[str]) -> pa.Schema:
    return pa.schema([(n, pa.int64()) for n in names])


def _longs(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns.values()], names=list(columns))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: its words, how many are removed and the digest of the kept ones.

    A word goes if a window of ``length`` words over it also starts in a document with a
    smaller doc_id. Null or empty text: no words. Rows of one doc_id are one document to
    each other: neither is smaller. Rows with a null doc_id stay whole and remove nothing.
    An empty table gives an empty result; other columns are not read. ``with_text`` adds
    the kept words, joined by one space, as ``kept``.
    """
    spark = docs.sparkSession
    W.small_batches(spark)
    docs = W.table(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scratch = Scratch(spark, "substrings")
    root = folder(spark, scratch)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = bucket_count(parts)
    shared, shards, hot_windows = (Sorted(f"{root}/{n}", buckets) for n in ("anchors", "shards", "windows"))
    known = docs.where("doc_id IS NOT NULL")

    def contexts(chunk: pa.Table) -> tuple[W.Words, Contexts, np.ndarray]:
        words = W.Words(W.texts(chunk["text"]))
        return words, Contexts(words, words.hashes(), length, gram), chunk["doc_id"].fill_null(-(1 << 63)).to_numpy()

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in W.chunks(batches):
            _, found, names = contexts(chunk)
            order = np.lexsort((names[found.document], found.anchor))
            a, d = found.anchor[order], names[found.document][order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])]) if len(a) else np.zeros(0, bool)
            yield _longs(anchor=a[new], doc=d[new])

    counted = known.mapInArrow(anchors, "anchor long, doc long").groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    counted = scratch.put(counted.select("anchor", (F.col("n") > hot).cast("long").alias("hot")), "anchors")
    _write_rows(counted, shared, "anchor", parts, hot=np.uint8)
    any_hot = counted.where("hot = 1").limit(1).count() > 0
    scratch.drop(counted)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in W.chunks(batches):
            _, found, names = contexts(chunk)
            is_shared, is_hot = shared.find(found.anchor, shared.bucket(found.anchor), hot=np.uint8)
            which = np.flatnonzero(is_shared & (is_hot == 0))
            one, two = found.digests(which)
            doc = names[found.document[which]]
            order = np.lexsort((doc, two, one))
            keep = order[np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])] if len(order) else order
            counts = found.n[which[keep]] + length - 1
            flat = found.flat[W.ragged(found.start[which[keep]], counts)]
            offsets = np.concatenate([[0], np.cumsum(counts)]) * 8
            payload = pa.Array.from_buffers(pa.binary(), len(keep), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
            anchor = found.anchor[which[keep]]
            for at in range(0, len(keep), 2000):
                s = slice(at, at + 2000)
                longs = _longs(bucket=shards.bucket(anchor[s]), anchor=anchor[s], one=one[keep][s], two=two[keep][s], doc=doc[keep][s])
                yield pa.RecordBatch.from_arrays([*longs.columns, payload[s]], names=[*longs.schema.names, "words"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []
        group: list[tuple] = []
        waiting: list[list[tuple]] = []
        held = 0

        def solve() -> None:
            nonlocal waiting, held
            automaton = SuffixAutomaton()
            told = sorted((x for g in waiting for x in g), key=lambda x: x[2])
            told = [(one, two, doc, np.frombuffer(words, "<u8").tolist()) for one, two, doc, words in told]
            for _, _, doc, words in told:
                automaton.add(words, doc)
            automaton.close()
            for one, two, doc, words in told:
                mask = 0
                for i, d in enumerate(automaton.first_documents(words, length)):
                    mask |= (d < doc) << i
                rows.append((one, two, doc, mask))
            waiting, held = [], 0

        def finish_group() -> None:
            nonlocal group, held
            if len(group) == 1:
                rows.append((*group[0][:3], 0))
            elif group:
                waiting.append(group)
                held += sum(len(g[3]) for g in group) // 8
                if held >= AUTOMATON_WORDS:
                    solve()
            group = []

        def finish_bucket() -> Iterator[pa.RecordBatch]:
            nonlocal rows
            finish_group()
            if waiting:
                solve()
            if rows:
                one, two, doc, mask = (np.array(c, t) for c, t in zip(zip(*rows, strict=True), (np.int64, np.int64, np.int64, np.uint64), strict=True))
                shards.write(bucket, one.view(np.uint64), two=two, doc=doc, mask=mask)
                yield _told(bucket, len(rows))
            rows = []

        last, seen = None, set()
        for batch in batches:
            for b, anchor, one, two, doc, words in zip(*(batch[c].to_pylist() for c in ("bucket", "anchor", "one", "two", "doc", "words")), strict=True):
                if b != bucket:
                    if bucket is not None:
                        yield from finish_bucket()
                    bucket, last = b, None
                if anchor != last:
                    finish_group()
                    last, seen = anchor, set()
                if (one, two) not in seen:  # rows come by document: the first has the least
                    seen.add((one, two))
                    group.append((one, two, doc, words))
        if bucket is not None:
            yield from finish_bucket()

    dealt = known.mapInArrow(emit, "bucket long, anchor long, one long, two long, doc long, words binary")
    judged = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "anchor", "doc").mapInArrow(judge, WRITTEN)
    shards.sizes = {r.bucket: r.n for r in judged.collect()}

    if any_hot:

        def emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in W.chunks(batches):
                _, found, names = contexts(chunk)
                is_shared, is_hot = shared.find(found.anchor, shared.bucket(found.anchor), hot=np.uint8)
                which = np.flatnonzero(is_shared & (is_hot == 1))
                _, one, two = found.window_digests(which)
                doc = np.repeat(names[found.document[which]], found.n[which])
                order = np.lexsort((doc, two, one))
                one, two, doc = one[order], two[order], doc[order]
                new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]) if len(one) else np.zeros(0, bool)
                last = np.append(new[1:], True) if len(one) else new
                yield _longs(one=one[new], two=two[new], lo=doc[new], hi=doc[last])

        windows = known.mapInArrow(emit_windows, "one long, two long, lo long, hi long").groupBy("one", "two").agg(F.min("lo").alias("doc"), F.max("hi").alias("hi")).where("doc < hi")
        _write_rows(windows, hot_windows, "one", parts, two=np.int64, doc=np.int64)

    schema = OUT + (", kept string" if with_text else "")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in W.chunks(batches):
            words, found, names = contexts(chunk)
            is_shared, is_hot = shared.find(found.anchor, shared.bucket(found.anchor), hot=np.uint8)
            valid = chunk["doc_id"].is_valid().to_numpy()
            is_shared &= valid[found.document]
            which = np.flatnonzero(is_shared & (is_hot == 0))
            one, two = found.digests(which)
            own = names[found.document[which]]
            there, check, doc, mask = shards.find(one, shards.bucket(found.anchor[which]), two=np.int64, doc=np.int64, mask=np.uint64)
            there &= check == two.view(np.int64)
            mask = np.where(own > doc, np.uint64((1 << 64) - 1), np.where(own == doc, mask, np.uint64(0)))
            mask[~there] = 0
            place = W.ragged(np.zeros(len(which), np.int64), found.n[which])
            gone = (np.repeat(mask, found.n[which]) >> place.astype(np.uint64)) & np.uint64(1)
            starts = W.ragged(found.start[which], found.n[which])[gone == 1]
            which = np.flatnonzero(is_shared & (is_hot == 1))
            if len(which):
                hot_starts, one, two = found.window_digests(which)
                there, check, doc = hot_windows.find(one, hot_windows.bucket(one), two=np.int64, doc=np.int64)
                own = np.repeat(names[found.document[which]], found.n[which])
                starts = np.concatenate([starts, hot_starts[there & (check == two.view(np.int64)) & (doc < own)]])
            change = np.bincount(starts, minlength=len(words.codes) + length + 1).astype(np.int64)
            change[length:] -= np.bincount(starts + length, minlength=len(change))[length : len(change)]
            keep = np.cumsum(change)[: len(words.codes)] == 0
            spelled = np.array(words.vocabulary.to_pylist(), object)
            digest, kept = [], []
            removed = words.counts - np.diff(np.concatenate([[0], np.cumsum(keep)])[words.starts])
            for a, b in zip(words.starts[:-1].tolist(), words.starts[1:].tolist(), strict=True):
                text = " ".join(spelled[words.codes[a:b][keep[a:b]]].tolist())
                digest.append(hashlib.sha256(text.encode()).hexdigest())
                if with_text:
                    kept.append(text)
            columns = [chunk["doc_id"].combine_chunks(), pa.array(words.counts), pa.array(removed), pa.array(digest, pa.string())]
            if with_text:
                columns.append(pa.array(kept, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in schema.split(", ")])

    return docs.mapInArrow(remove, schema)

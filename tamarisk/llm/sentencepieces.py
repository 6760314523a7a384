"""SentencePiece encoding and decoding in batched numpy.

Text is cut where no piece can reach across (before each run of spaces, around line
ends); equal segments are solved once, and segments of equal length advance together.

``viterbi``: best-scoring segmentation of a unigram model. At each end position, for each
piece length, the hashes of all segments' substrings probe the sorted piece keys; vectorised
maxima store backpointers. ``bpe``: the merges of a BPE model, over the same segments.

A model file says which of the two it is. For a BPE file the best-scoring path is *not* the
library's answer (its scores order merges, they are no log-probabilities), so :func:`encode`
uses the merges for it, and the Viterbi path is offered beside it over the same pieces.
Characters without a piece become their bytes' pieces.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm import words as W
from tamarisk.llm.bpe import NONE, PairTable, merge

SPACE = "▁"
#: Upper bits of a hash by which its place among the sorted keys is looked up.
TOP = 20
#: Longer segments go through the library (merges) or alone (Viterbi).
LONGEST = 64
SEGMENTS = re.compile(r"\n+| *[^ \n]+| +")
SCHEMA = "doc_id long, n_ids long, ids array<int>, ids_crc32 long, n_byte_ids long, viterbi_n_ids long, viterbi_ids_crc32 long, viterbi_score double, round_trip boolean"
BASE = np.uint64(0x100000001B3)


def string_hashes(strings: list[str]) -> np.ndarray:
    """The polynomial hash of each whole string, as :meth:`Pieces._viterbi_equal` has it of substrings."""
    out = np.zeros(len(strings), np.uint64)
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    for length in np.unique(sizes).tolist():
        group = np.flatnonzero(sizes == length)
        points = np.frombuffer("".join([strings[i] for i in group.tolist()]).encode("utf-32-le"), np.uint32).reshape(len(group), length)
        letters = W.mix(points.astype(np.uint64) + np.uint64(1))
        for j in range(length):
            out[group] = out[group] * BASE + letters[:, j]
    return out


class Pieces:
    """A model's pieces: ids, scores, sorted hash keys and merges."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.name != "identity" or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only models with identity normalisation and a dummy prefix are supported")
        self.kind = {1: "unigram", 2: "bpe"}[model.trainer_spec.model_type]
        self.text = [p.piece for p in model.pieces]
        self.score = np.array([p.score for p in model.pieces], np.float64)
        normal = [i for i, p in enumerate(model.pieces) if p.type == 1]
        if any(SPACE in self.text[i].lstrip(SPACE) for i in normal):
            raise ValueError("a piece reaches across the start of a word")
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.byte = np.zeros(256, np.int32)
        self.is_byte = np.zeros(len(self.text), bool)
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte[int(p.piece[1:-1], 16)] = i
                self.is_byte[i] = True
        raw = [bytes([int(t[1:-1], 16)]) if b else t.encode() for t, b in zip(self.text, self.is_byte, strict=True)]
        self.spelled = np.frombuffer(b"".join(raw), np.uint8)
        self.spelled_sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.spelled_starts = np.cumsum(self.spelled_sizes) - self.spelled_sizes
        self.unknown_score = float(self.score[normal].min()) - 10.0
        number = {self.text[i]: i for i in normal}
        # sorted piece keys of the Viterbi search
        keys = string_hashes([self.text[i] for i in normal])
        order = np.argsort(keys)
        self.keys, self.key_id = keys[order], np.array(normal, np.int32)[order]
        assert len(np.unique(keys)) == len(keys), "two pieces share a hash"
        # where in the sorted keys those with some upper bits begin: most other hashes meet an empty place
        self.first = np.append(np.searchsorted(self.keys, np.arange(1 << TOP, dtype=np.uint64) << np.uint64(64 - TOP)), len(self.keys)).astype(np.int32)
        self.some = self.first[1:] > self.first[:-1]
        self.most = int((self.first[1:] - self.first[:-1]).max())
        self.lengths = sorted({len(self.text[i]) for i in normal})
        # merges: every way to put two symbols together into a piece; single characters
        # without a piece of their own take numbers from the end of the vocabulary
        self.symbol = {t: i for t, i in number.items()}
        self.extra: list[str] = []
        for t in number:
            for c in t:
                if c not in self.symbol:
                    self.symbol[c] = len(self.text) + len(self.extra)
                    self.extra.append(c)
        left, right, rank, made = [], [], [], []
        by_score = sorted(normal, key=lambda i: -self.score[i])
        for r, i in enumerate(by_score):
            t = self.text[i]
            for k in range(1, len(t)):
                if (a := self.symbol.get(t[:k])) is not None and (b := self.symbol.get(t[k:])) is not None:
                    left.append(a), right.append(b), rank.append(r), made.append(i)
        self.pairs = PairTable(left, right, rank, made)
        points = np.array([ord(c) for c in self.symbol if len(c) == 1], np.int64)
        self.points = np.sort(points)
        self.point_symbol = np.array([self.symbol[chr(p)] for p in self.points], np.int64)

    def units(self, points: np.ndarray) -> np.ndarray:
        """Symbol of each code point; unknown ones are minus the code point less one."""
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        return np.where(self.points[at] == points, self.point_symbol[at], -points - 1)

    def with_bytes(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols without a piece (negative, or extra characters) replaced by byte pieces."""
        odd = (flat < 0) | (flat >= len(self.text))
        if not odd.any():
            return flat.astype(np.int32), counts
        reps = np.ones(len(flat), np.int64)
        spelled = {int(x): self.byte[np.frombuffer((chr(-int(x) - 1) if x < 0 else self.extra[int(x) - len(self.text)]).encode("utf-8", "surrogatepass"), np.uint8)] for x in np.unique(flat[odd])}
        reps[odd] = [len(spelled[int(x)]) for x in flat[odd]]
        out = np.repeat(flat, reps).astype(np.int64)
        starts = np.cumsum(reps) - reps
        for i in np.flatnonzero(odd).tolist():
            out[starts[i] : starts[i] + reps[i]] = spelled[int(flat[i])]
        total = np.concatenate([[0], np.cumsum(reps)])
        ends = np.cumsum(counts)
        return out.astype(np.int32), total[ends] - total[ends - counts]

    def bpe(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids a segment) by merging."""
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        short = np.flatnonzero(sizes <= LONGEST)
        points = np.frombuffer("".join([segments[i] for i in short.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        symbols = self.units(points)
        known = np.where(symbols < 0, np.int64(NONE) - 1, symbols)
        flat, made = merge_keeping(self.pairs, known, symbols, sizes[short])
        flat, made = self.with_bytes(flat, made)
        if len(short) == len(segments):
            return flat, made
        counts = np.zeros(len(segments), np.int64)
        counts[short] = made
        long = {i: self.by_library(segments[i]) for i in np.flatnonzero(sizes > LONGEST).tolist()}
        for i, e in long.items():
            counts[i] = len(e)
        out = np.zeros(int(counts.sum()), np.int32)
        keep = np.ones(len(out), bool)
        ends = np.cumsum(counts)
        for i, e in long.items():
            keep[ends[i] - counts[i] : ends[i]] = False
            out[ends[i] - counts[i] : ends[i]] = e
        out[keep] = flat
        return out, counts

    def by_library(self, segment: str) -> list[int]:
        """The library adds a prefix space: hide it by a line end, and take both off again."""
        return self.library.encode("\n" + segment.replace(SPACE, " "))[2:]

    def viterbi(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, ids a segment, score a segment): the best-scoring segmentation of each."""
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        order = np.argsort(sizes, kind="stable")
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        scores = np.zeros(len(segments))
        bounds = np.flatnonzero(np.diff(sizes[order])) + 1
        for group in np.split(order, bounds):
            length = int(sizes[group[0]]) if len(group) else 0
            step = max(1, (1 << 20) // max(1, length))
            for at in range(0, len(group) if length else 0, step):
                part = group[at : at + step]
                points = np.frombuffer("".join([segments[i] for i in part.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), length)
                flat, counts, score = self._viterbi_equal(points.astype(np.int64))
                scores[part] = score
                rows.append((part, flat, counts))
        made = np.zeros(len(segments), np.int64)
        for part, _, counts in rows:
            made[part] = counts
        ends = np.cumsum(made)
        out = np.zeros(int(made.sum()), np.int64)
        for part, flat, counts in rows:
            out[W.ragged(ends[part] - counts, counts)] = flat
        flat, counts = self.with_bytes(out, made)
        return flat, counts, scores

    def probe(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the hashes are pieces' keys, the ids of those pieces)."""
        top = (key >> np.uint64(64 - TOP)).astype(np.int64)
        which = np.flatnonzero(self.some[top])
        at, end, wanted = self.first[top[which]], self.first[top[which] + 1], key[which]
        place = at.copy()
        for i in range(1, self.most):
            place += (self.keys[place] != wanted) & (at + i < end)
        hit = self.keys[place] == wanted
        return which[hit], self.key_id[place[hit]]

    def _viterbi_equal(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, length = points.shape
        # a row a position, so that all segments' values at one lie together
        points = np.ascontiguousarray(points.T)
        letters = W.mix((points + 1).astype(np.uint64))
        prefix = np.zeros((length + 1, n), np.uint64)
        for j in range(length):
            prefix[j + 1] = prefix[j] * BASE + letters[j]
        best = np.zeros((length + 1, n))
        back = np.ones((length + 1, n), np.int64)
        piece = np.zeros((length + 1, n), np.int64)
        power = {k: np.uint64(pow(int(BASE), k, 1 << 64)) for k in self.lengths}
        for j in range(1, length + 1):
            best[j] = best[j - 1] + self.unknown_score
            piece[j] = -points[j - 1] - 1
            for k in self.lengths:
                if k > j:
                    break
                found, number = self.probe(prefix[j] - prefix[j - k] * power[k])
                score = best[j - k, found] + self.score[number]
                if k > 1:  # a known character is never unknown
                    better = score > best[j, found]
                    found, number, score = found[better], number[better], score[better]
                best[j, found], back[j, found], piece[j, found] = score, k, number
        at = np.full(n, length)
        taken, where = [], []
        rows = np.arange(n)
        while len(rows):
            taken.append(piece[at[rows], rows])
            where.append(rows)
            at[rows] -= back[at[rows], rows]
            rows = rows[at[rows] > 0]
        where_flat, taken_flat = np.concatenate(where), np.concatenate(taken)
        turn = np.concatenate([np.full(len(w), i) for i, w in enumerate(where)])
        order = np.lexsort((-turn, where_flat))
        return taken_flat[order], np.bincount(where_flat, minlength=n), best[length]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, byte pieces as UTF-8, the dummy prefix taken off."""
        out = b"".join(bytes([int(self.text[i][1:-1], 16)]) if self.is_byte[i] else self.text[i].encode() for i in ids.tolist())
        text = out.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def merge_keeping(pairs: PairTable, known: np.ndarray, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`merge`, with unknown symbols (which never merge) put back into their places."""
    unknown = symbols < 0
    flat, made = merge(pairs, known.astype(np.int64), sizes)
    flat = flat.astype(np.int64)
    if unknown.any():
        flat[flat == int(NONE) - 1] = symbols[unknown]
    return flat, made


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def segments(text: str) -> list[str]:
    """The parts of a text (with its dummy prefix) that no piece reaches across."""
    return [s.replace(" ", SPACE) for s in SEGMENTS.findall(" " + text)]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """Ids of every whole text, by the model's own segmentation, with the Viterbi path beside it.

    ``ids``: the model's ids (equal to the library's); ``round_trip``: whether both
    segmentations decode to the text again (not where it holds U+2581, which stands for a space). Null and empty text: no ids, true. Equal rows
    give equal rows; an empty table an empty result; other columns are not read.
    """
    W.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_ = pieces(model)
        for chunk in W.chunks(batches, W.CHUNK_BYTES // 2):
            texts = W.texts(chunk["text"]).to_pylist()
            numbers: dict[str, int] = {}
            per = [[numbers.setdefault(s, len(numbers)) for s in SEGMENTS.findall(" " + t)] if t else [] for t in texts]
            sizes = np.fromiter(map(len, per), np.int64, len(per))
            own = np.fromiter(itertools.chain.from_iterable(per), np.int64, int(sizes.sum()))
            del per
            distinct = [s.replace(" ", SPACE) for s in numbers]
            v_flat, v_counts, v_score = model_.viterbi(distinct)
            flat, counts = model_.bpe(distinct) if model_.kind == "bpe" else (v_flat, v_counts)
            # a text's own U+2581 decodes to a space
            same = decodes(model_, distinct, flat, counts) & decodes(model_, distinct, v_flat, v_counts) & np.fromiter((SPACE not in s for s in numbers), bool, len(numbers))
            bytes_ = np.add.reduceat(np.append(model_.is_byte[flat], 0), np.cumsum(counts) - counts)[: len(counts)] * (counts > 0) if len(counts) else counts
            per_text = lambda x: np.add.reduceat(np.append(x[own], x.dtype.type(0)), np.cumsum(sizes) - sizes)[: len(sizes)] * (sizes > 0) if len(sizes) else sizes
            ids, n_ids = flat[W.ragged((np.cumsum(counts) - counts)[own], counts[own])].astype("<u4"), per_text(counts)
            best, n_best = v_flat[W.ragged((np.cumsum(v_counts) - v_counts)[own], v_counts[own])].astype("<u4"), per_text(v_counts)
            arrays = [
                pa.array(n_ids),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_ids)]), pa.int32()), pa.array(ids.view(np.int32))),
                pa.array(checksums(ids, n_ids), pa.int64()),
                pa.array(per_text(bytes_)),
                pa.array(n_best),
                pa.array(checksums(best, n_best), pa.int64()),
                pa.array(per_text(v_score)),
                pa.array(per_text((~same).astype(np.int64)) == 0),
            ]
            yield pa.RecordBatch.from_arrays([chunk["doc_id"].combine_chunks(), *arrays], names=[c.split(" ")[0] for c in SCHEMA.split(", ")])

    return W.table(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def checksums(flat: np.ndarray, counts: np.ndarray) -> list[int]:
    """crc32 of each run of little-endian ids."""
    raw, ends = memoryview(flat.tobytes()), np.cumsum(counts) * 4
    return [zlib.crc32(raw[a:b]) for a, b in zip((ends - counts * 4).tolist(), ends.tolist(), strict=True)]


def decodes(model: Pieces, distinct: list[str], flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether each segment's ids spell it: all bytes of all pieces against all bytes of the segments."""
    if not len(distinct):
        return np.zeros(0, bool)
    wanted = [s.encode("utf-8", "surrogatepass") for s in distinct]
    sizes = np.fromiter(map(len, wanted), np.int64, len(wanted))
    lengths = model.spelled_sizes[flat]
    total = np.concatenate([[0], np.cumsum(lengths)])
    ends = np.cumsum(counts)
    right = total[ends] - total[ends - counts] == sizes
    made = model.spelled[W.ragged(model.spelled_starts[flat], lengths)]
    which = np.flatnonzero(right)
    a = made[W.ragged(total[ends - counts][which], sizes[which])]
    b = np.frombuffer(b"".join([wanted[i] for i in which.tolist()]), np.uint8)
    wrong = np.concatenate([[0], np.cumsum(a != b)])
    ends = np.cumsum(sizes[which])
    right[which] = wrong[ends] == wrong[ends - sizes[which]]
    return right


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids). Null or no ids: the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_ = pieces(model)
        for batch in batches:
            out = [model_.decode(np.array(x or [], np.int64)) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out, pa.string())], names=["doc_id", "text"])

    return W.table(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")

"""Vectorised word handling shared by the operators: one C++ pass splits and numbers words.

A *word* is a maximal run of code points outside ``[\\x20\\x09-\\x0D]``. A chunk of
documents becomes flat word codes plus document offsets, so all later work is
numpy over codes and Python touches each *distinct* word at most once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tamarisk.session import BATCH_ROWS, small_batches  # noqa: F401  all operators ask for the same

#: Bytes of text that are worked on at once; bounds a Python worker's memory.
CHUNK_BYTES = 12 << 20


def table(frame, *names: str):
    """The named columns of a DataFrame, by exact name, whatever else it carries."""
    return frame.select(*[frame[f"`{n}`"] for n in names])


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Arrow batches regrouped to about ``limit`` bytes; a larger single row stays whole."""
    held, size = [], 0
    for batch in batches:
        rows = max(1, int(batch.num_rows * limit / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            held.append(part)
            size += part.nbytes
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def texts(column: pa.ChunkedArray) -> pa.Array:
    """One string array; null becomes the empty text."""
    column = column.cast(pa.large_string())
    column = pc.fill_null(column, "")
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


class Words:
    """Flat word codes of a chunk: ``codes[starts[i]:starts[i + 1]]`` are document i's words."""

    def __init__(self, array: pa.Array, lower: bool = False):
        if lower:
            array = lower_ascii(array)
        split = pc.ascii_split_whitespace(array)
        if isinstance(split, pa.ChunkedArray):
            split = split.combine_chunks()
        offsets = split.offsets.to_numpy().astype(np.int64)
        encoded = split.values.dictionary_encode()
        codes = encoded.indices.to_numpy(zero_copy_only=False)
        self.vocabulary = encoded.dictionary
        empty = pc.index(self.vocabulary, pa.scalar("", self.vocabulary.type)).as_py()
        if empty >= 0:
            keep = codes != empty
            total = np.concatenate([[0], np.cumsum(keep)])
            offsets, codes = total[offsets], codes[keep]
        self.codes, self.starts = codes.astype(np.int64), offsets - offsets[0]
        self.counts = np.diff(self.starts)

    @property
    def documents(self) -> np.ndarray:
        """The document of each flat word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def sums(self, per_word: np.ndarray) -> np.ndarray:
        """Per document, the sum over its words of a value given per distinct word."""
        total = np.concatenate([[0], np.cumsum(per_word[self.codes])]) if len(per_word) else np.zeros(1, np.int64)
        return total[self.starts[1:]] - total[self.starts[:-1]]

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each distinct word."""
        return hash_strings(self.vocabulary, seed)


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lower_ascii(array: pa.Array) -> pa.Array:
    """A-Z lower-cased and nothing else, on the UTF-8 bytes (continuation bytes are above 0x7F)."""
    array = array.cast(pa.large_string())
    if array.offset:
        array = pa.concat_arrays([array])
    validity, offsets, data = array.buffers()
    if data is None:
        return array
    return pa.Array.from_buffers(array.type, len(array), [validity, offsets, pa.py_buffer(data.to_pybytes().translate(_LOWER))])


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_strings(array: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of strings by xxh3."""
    from xxhash import xxh3_64_intdigest as digest

    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary())
    return np.fromiter((digest(w, seed) for w in array.to_pylist()), np.uint64, len(array))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Order-sensitive hash of each run of ``width`` values of a flat array (``len - width + 1`` of them)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    return mix(out)


def run_starts(x: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours begins; none in an empty array."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices that gather the runs ``[starts[i], starts[i] + counts[i])`` one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)

"""Cost-balanced sequence packing.

The cost of a piece of n tokens is ``linear * n + quadratic * n * n`` (attention
within the document). Documents, longest first, go to the sequence of lowest cost
that still has room for them. A document longer than a sequence is first cut into
whole sequences; a piece that fits nowhere whole is cut to fill the roomiest one.

Blocks are packed where the documents are read: no shuffle, no state between
tasks, and a lost task is redone alike. Each block opens exactly the sequences its
tokens fill: whole ones, and for the remainder one a power of two each, which
needs no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm import words as W

CAPACITY = 2048
END_ID = 1
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Tokens packed together; bounds a task's memory and the time of one block.
BLOCK_TOKENS = 1 << 22
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


def assign(lengths: np.ndarray, rooms: np.ndarray, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int]]:
    """(item, start in item, length, bin) with every token placed; ``rooms`` must hold them all.

    Ties: the earlier item and the earlier bin come first, so the result is a function of its input.
    """
    room, cost = rooms.astype(np.int64).copy(), np.zeros(len(rooms))
    placed = []
    for item in np.argsort(-lengths, kind="stable").tolist():
        left, start = int(lengths[item]), 0
        while left:
            fits = np.where(room >= left, cost, np.inf)
            best = int(fits.argmin())
            take = left
            if room[best] < left:
                best = int(room.argmax())
                take = int(room[best])
            placed.append((item, start, take, best))
            room[best] -= take
            cost[best] += linear * take + quadratic * take * take
            start, left = start + take, left - take
    return placed


def sequence_rooms(total: int, capacity: int) -> np.ndarray:
    """Sequences that hold ``total`` tokens exactly: whole ones, then the remainder's powers of two."""
    rest = total % capacity
    return np.array([capacity] * (total // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], np.int64)


def pack_block(ids: list[np.ndarray], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray]:
    """((document, start, length, sequence, offset), sequence lengths) of a block of documents' ids."""
    sizes = np.array([len(x) for x in ids], np.int64)
    whole = sizes // capacity
    tails = sizes % capacity
    pieces, sequence = [], 0
    for d in np.flatnonzero(whole).tolist():
        for k in range(int(whole[d])):
            pieces.append((d, k * capacity, capacity, sequence, 0))
            sequence += 1
    rooms = sequence_rooms(int(tails.sum()), capacity)
    filled = np.zeros(len(rooms), np.int64)
    for d, start, length, at in assign(tails, rooms):
        pieces.append((d, int(whole[d]) * capacity + start, length, sequence + at, int(filled[at])))
        filled[at] += length
    return pieces, np.concatenate([np.full(sequence, capacity, np.int64), rooms])


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents, each token id in exactly one.

    Null text counts as empty (its end id alone is a piece); equal rows are packed each on
    their own; a null doc_id stays null; other columns of ``docs`` are not read. An empty
    table gives an empty result. ``with_ids`` adds the piece's ids as ``ids``.
    Sequence ids are unique over the run: the task's number in the upper bits.
    """
    W.small_batches(docs.sparkSession)
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        from tamarisk.llm.bpe import word_end_bpe

        encoder = word_end_bpe(tokenizer)
        first = TaskContext.get().partitionId() << 40
        names, ids, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal first, names, ids, held
            pieces, sizes = pack_block(ids, capacity)
            columns = np.array(pieces, np.int64).reshape(-1, 5).T
            d, start, length, sequence, offset = columns
            parts = [ids[i][a : a + n] for i, a, n in zip(d.tolist(), start.tolist(), length.tolist(), strict=True)]
            crc = [zlib.crc32(p.astype("<u4").tobytes()) for p in parts]
            out = [pa.array([names[i] for i in d.tolist()], pa.int64()), start, length, np.array(crc, np.int64), np.array([len(x) for x in ids], np.int64)[d], first + sequence, offset, sizes[sequence]]
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in out]
            if with_ids:
                arrays.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
            first += len(sizes)
            names, ids, held = [], [], 0
            return pa.RecordBatch.from_arrays(arrays, names=[c.split(" ")[0] for c in schema.split(", ")])

        for chunk in W.chunks(batches):
            words = W.Words(W.texts(chunk["text"]))
            flat, counts = encoder.encode(words.vocabulary)
            starts = np.cumsum(counts) - counts
            for i, name in enumerate(chunk["doc_id"].to_pylist()):
                own = words.codes[words.starts[i] : words.starts[i + 1]]
                own = np.append(flat[W.ragged(starts[own], counts[own])], end_id).astype(np.uint32)
                names.append(name)
                ids.append(own)
                held += len(own)
                if held >= block_tokens:
                    yield flush()
        if ids:
            yield flush()

    return W.table(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)

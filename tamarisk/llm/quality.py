"""Document quality by tokeniser fertility.

Two public vocabularies measure each text: characters per token of both, the share of
byte-fallback tokens and the entropy of the token distribution. A language (or, for
an unknown one, the dominant script) has a band for each measure; a text outside any
band is rejected. Plain counts (words, symbols, repeated lines and windows) come beside.

Each *distinct* word of a chunk is tokenised once; everything per document is numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm import words as W

SYMBOLS = "#*$%&|<>"
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_tokens long, chars_per_token double, chars_per_token_2 double, byte_share double, entropy double"
)

#: Per language or script: (least, most) characters per token of either vocabulary, most
#: byte-fallback share, least token entropy of a window relative to what its size allows. Lower bounds
#: of fertility give way by ``SLACK / sqrt(tokens)``, the spread of a mean over few tokens.
#: The four languages' bounds lie below nearly all documents labelled good (0.4 % of them
#: fall out at scale factor 0.1); the scripts' bounds only catch what is far off.
BANDS = {
    "en": ((2.09, 8.0), (2.26, 8.0), 0.05, 0.84),
    "fr": ((1.86, 8.0), (1.88, 8.0), 0.05, 0.84),
    "de": ((2.12, 8.0), (2.08, 8.0), 0.05, 0.84),
    "es": ((1.84, 8.0), (1.84, 8.0), 0.05, 0.84),
    "latin": ((1.4, 8.0), (1.3, 8.0), 0.10, 0.60),
    "arabic": ((0.7, 6.0), (0.5, 6.0), 0.30, 0.60),
    "other": ((0.3, 8.0), (0.3, 8.0), 0.90, 0.50),
}
SLACK = 1.5
#: Tokens of a window whose entropy is taken.
WINDOW = 50


def scripts(texts: pa.Array) -> list[str]:
    """latin, arabic or other, by most of the letters of each text; latin where there are none."""
    letters = lambda pattern: pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
    latin, arabic = letters(r"[A-Za-zªµºÀ-ÖØ-öø-ɏ]"), letters(r"[\x{620}-\x{64A}\x{66E}\x{66F}\x{671}-\x{6D3}\x{6D5}\x{6E5}\x{6E6}\x{6EE}\x{6EF}\x{6FA}-\x{6FC}\x{6FF}\x{750}-\x{77F}\x{8A0}-\x{8B4}]")
    other = letters(r"\p{L}") - latin - arabic
    return [max((a, 2, "latin"), (b, 1, "arabic"), (c, 0, "other"))[2] for a, b, c in zip(latin.tolist(), arabic.tolist(), other.tolist(), strict=True)]


def repeated_words(codes: np.ndarray, starts: np.ndarray, width: int = 3) -> np.ndarray:
    """Per document, the words inside a ``width``-word window that occurs twice or more in it (exact)."""
    out = np.zeros(len(starts) - 1, np.int64)
    bits = max(1, int(codes.max(initial=0)).bit_length())
    if bits * width > 63:  # number the windows step by step where they don't fit one integer
        keys = codes.astype(np.int64)
        for i in range(1, width):
            keys = keys[: len(codes) - i] * (int(codes.max()) + 1) + codes[i:]
            keys = np.unique(keys, return_inverse=True)[1]
    else:
        keys = np.zeros(max(0, len(codes) - width + 1), np.int64)
        for i in range(width):
            keys = (keys << bits) | codes[i : len(codes) - width + 1 + i]
    for d, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
        n = b - a - width + 1
        if n < 2:
            continue
        own = keys[a : a + n]
        order = own.argsort(kind="stable")
        ranked = own[order]
        same = ranked[1:] == ranked[:-1]
        if same.any():
            twice = np.zeros(n, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(n + width - 1, bool)
            for i in range(width):
                covered[i : i + n] |= twice
            out[d] = covered.sum()
    return out


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def entropies(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, words: W.Words, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, entropy of the token distribution) per document: the mean over windows of ``width`` tokens, 1 where all of a window's differ.

    Windows cover the whole text (the last one ends with it), and are of one size, so the measure does not
    depend on the length. A text of fewer tokens is one window; one of fewer than two has 1.
    """
    n_tokens = words.sums(counts)
    ids = flat[W.ragged(starts[words.codes], counts[words.codes])] if len(words.codes) else flat[:0]
    begins = np.cumsum(n_tokens) - n_tokens
    out = np.ones(len(n_tokens))
    for size in np.unique(np.minimum(n_tokens, width)).tolist():
        if size < 2:
            continue
        which = np.flatnonzero(np.minimum(n_tokens, width) == size)
        per = -(-n_tokens[which] // size)
        place = np.minimum(W.ragged(np.zeros(len(which), np.int64), per) * size, np.repeat(n_tokens[which] - size, per))
        rows = np.sort(ids[(np.repeat(begins[which], per) + place)[:, None] + np.arange(size)], axis=1)
        new = np.ones(rows.shape, bool)
        new[:, 1:] = rows[:, 1:] != rows[:, :-1]
        first = np.flatnonzero(new.ravel())
        runs = np.diff(np.append(first, rows.size)).astype(np.float64)
        lost = np.bincount(first // size, runs * np.log2(runs), len(rows)) / size / np.log2(size)
        out[which] = 1 - np.bincount(np.repeat(np.arange(len(which)), per), lost, len(which)) / per
    return n_tokens, out


def judged(chunk: pa.Table, piece_model: str, word_model: str, bands=BANDS) -> list[np.ndarray]:
    """The columns of ``SCHEMA`` after doc_id, of a chunk with text and lang."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tamarisk.llm.bpe import word_end_bpe
    from tamarisk.llm.sentencepieces import SPACE, pieces

    model, other = pieces(piece_model), word_end_bpe(word_model)
    texts = W.texts(chunk["text"])
    words = W.Words(texts)
    vocabulary = words.vocabulary.to_pylist()
    chars = pc.utf8_length(words.vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
    symbols = pc.count_substring_regex(words.vocabulary, "[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(np.int64)
    flat, counts = model.bpe([SPACE + w for w in vocabulary])
    starts = np.cumsum(counts) - counts
    total = np.concatenate([[0], np.cumsum(model.is_byte[flat])])
    fallback = total[starts + counts] - total[starts]
    _, other_counts = other.encode(words.vocabulary)
    n_words, word_chars = words.counts, words.sums(chars)
    repeat = repeated_words(words.codes, words.starts)
    n_tokens, entropy = entropies(flat, starts, counts, words)
    other_tokens = words.sums(other_counts)
    raw = texts.to_pylist()
    per = word_chars / np.maximum(n_tokens, 1)
    per_2 = word_chars / np.maximum(other_tokens, 1)
    share = words.sums(fallback) / np.maximum(n_tokens, 1)
    failed = (n_words < 50) | (100 * repeat > 50 * n_words)
    within = np.zeros(len(raw), bool)
    names = chunk["lang"].to_pylist()
    unknown = [i for i, name in enumerate(names) if name not in bands and not failed[i]]
    for i, name in zip(unknown, scripts(texts.take(pa.array(unknown, pa.int64()))) if unknown else (), strict=True):
        names[i] = name
    for i, name in enumerate(names):
        if not failed[i]:
            band = bands[name]
            slack = SLACK / np.sqrt(max(1, n_tokens[i]))
            within[i] = band[0][0] - slack <= per[i] <= band[0][1] and band[1][0] - slack <= per_2[i] <= band[1][1] and share[i] <= band[2] and entropy[i] >= band[3]
    return [n_words, word_chars, words.sums(symbols), np.array([duplicate_lines(t) for t in raw], np.int64), repeat, failed, ~failed & within, n_tokens, per, per_2, share, entropy]


def measure(docs: DataFrame, piece_model: str, word_model: str, bands=BANDS) -> DataFrame:
    """Counts, measures and verdict of every whole text.

    Null or empty text: no words, base failed. Equal rows give equal rows; an empty table an
    empty result; columns other than doc_id, text and lang (may be absent) are not read.
    """
    W.small_batches(docs.sparkSession)
    lang = docs["lang"] if "lang" in docs.columns else F.lit(None)
    table = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), lang.cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in W.chunks(batches):
            columns = [pa.array(x) for x in judged(chunk, piece_model, word_model, bands)]
            yield pa.RecordBatch.from_arrays([chunk["doc_id"].combine_chunks(), *columns], names=[c.split(" ")[0] for c in SCHEMA.split(", ")])

    return table.mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, piece_model: str, word_model: str, bands=BANDS) -> DataFrame:
    """The rows of ``docs`` (any columns, with text and lang) that :func:`measure` keeps, judged where they are read."""
    W.small_batches(docs.sparkSession)
    names, place = docs.columns, [c.split(" ")[0] for c in SCHEMA.split(", ")].index("kept") - 1
    own = docs.select(*(docs[f"`{c}`"] for c in names), docs["text"].cast("string").alias("_text"), (docs["lang"] if "lang" in names else F.lit(None)).cast("string").alias("_lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in W.chunks(batches):
            kept = judged(pa.table({"text": chunk["_text"], "lang": chunk["_lang"]}), piece_model, word_model, bands)[place]
            yield from chunk.select(names).filter(pa.array(kept)).to_batches()

    return own.mapInArrow(run, docs.schema)

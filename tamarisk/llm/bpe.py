"""Byte-pair merging over many words at once, in numpy.

Words with equally many symbols advance together: at every length the lowest
ranked pair of each word is merged, which moves the word to the next shorter
length. The merges, their ranks and ids come from the public tokenizer's file,
so the ids are those of its own library, at a fraction of the cost a word.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tamarisk.llm.words import ragged

#: Words of more symbols go to the tokenizer's own library, which is linear in them.
LONGEST = 48
NONE = np.int32(2**31 - 1)
#: Letters whose lower case is one letter whatever surrounds it, and signs.
SAFE = r"^[!-~À-įı-ňŊ-ž]*$"
#: Letters, then signs: two parts of the pre-tokenizer, split in C++.
SIMPLE = r"^(?P<a>[a-zß-öø-ÿ]{0,24})(?P<b>[!-/:-@\[-`{-~]{0,24})$"


class PairTable:
    """(left, right) -> (rank, merged) in an open-addressing table of two gathers a probe."""

    def __init__(self, left, right, rank, merged):
        keys = (np.asarray(left, np.uint64) << np.uint64(32)) | np.asarray(right, np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        size = 1 << self.bits
        self.keys = np.full(size, np.iinfo(np.uint64).max, np.uint64)
        self.rank = np.full(size, NONE, np.int32)
        self.merged = np.zeros(size, np.int32)
        slot, left_over = self._slot(keys), np.arange(len(keys))
        rank, merged = np.asarray(rank, np.int32), np.asarray(merged, np.int32)
        while len(left_over):
            free = self.keys[slot] == np.iinfo(np.uint64).max
            first = np.zeros(len(slot), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.rank[slot[put]], self.merged[slot[put]] = keys[left_over[put]], rank[left_over[put]], merged[left_over[put]]
            slot, left_over = (slot[~put] + 1) % size, left_over[~put]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of the pairs, whose rank is NONE where the pair is unknown."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(keys)
        there = self.keys[slot]
        odd = np.flatnonzero((there != keys) & (there != np.iinfo(np.uint64).max))
        while len(odd):
            slot[odd] = (slot[odd] + 1) % len(self.keys)
            there = self.keys[slot[odd]]
            odd = odd[(there != keys[odd]) & (there != np.iinfo(np.uint64).max)]
        slot[self.keys[slot] != keys] = -1
        return slot

    def ranks(self, slot: np.ndarray) -> np.ndarray:
        return np.where(slot >= 0, self.rank[slot], NONE)


def merge(pairs: PairTable, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merged symbols of words given flat with their counts: (flat ids, counts)."""
    starts = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    out_rows: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    held_ids = held = slots = None
    length = int(counts.max(initial=0))
    while length:
        end = at
        while end < len(order) and counts[order[end]] == length:
            end = end + int(np.searchsorted(-counts[order[end:]], -length, side="right"))
        fresh = order[at:end]
        at = end
        if len(fresh):
            rows = symbols[starts[fresh][:, None] + np.arange(length)]
            new = pairs.find(rows[:, :-1].ravel(), rows[:, 1:].ravel()).reshape(len(fresh), length - 1)
            if held is None or not len(held):
                held_ids, held, slots = fresh, rows, new
            else:
                held_ids, held, slots = np.concatenate([held_ids, fresh]), np.vstack([held, rows]), np.vstack([slots, new])
        if held is None or not len(held):
            length = int(counts[order[at]]) if at < len(order) else 0
            continue
        if length == 1:
            out_rows.append((held_ids, held))
            break
        rank = pairs.ranks(slots)
        where = rank.argmin(axis=1)
        live = rank[np.arange(len(rank)), where] != NONE
        if not live.all():
            out_rows.append((held_ids[~live], held[~live]))
            held_ids, held, slots, where = held_ids[live], held[live], slots[live], where[live]
        if len(held):
            n = np.arange(len(held))
            made = pairs.merged[slots[n, where]]
            column = np.arange(length - 1)
            source = column + (column > where[:, None])
            held = np.take_along_axis(held, source, axis=1)
            held[n, where] = made
            if length > 2:
                column = np.arange(length - 2)
                slots = np.take_along_axis(slots, column + (column >= where[:, None]), axis=1)
                has = np.flatnonzero(where > 0)
                slots[has, where[has] - 1] = pairs.find(held[has, where[has] - 1], held[has, where[has]])
                has = np.flatnonzero(where < length - 2)
                slots[has, where[has]] = pairs.find(held[has, where[has]], held[has, where[has] + 1])
            else:
                slots = np.zeros((len(held), 0), np.int64)
        length -= 1
    made = np.zeros(len(counts), np.int64)
    for ids, rows in out_rows:
        made[ids] = rows.shape[1]
    ends = np.cumsum(made)
    flat = np.zeros(int(made.sum()), np.int32)
    for ids, rows in out_rows:
        flat[(ends[ids] - rows.shape[1])[:, None] + np.arange(rows.shape[1])] = rows
    return flat, made


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte, as byte-level vocabularies write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordEndBpe:
    """A ``tokenizers`` BPE file with word ends: ids of many words at once.

    Words of ASCII and Latin letters and signs go through :func:`merge`; any other word,
    and one of more than ``LONGEST`` bytes a part, goes through the library as it is.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        end = spec["model"]["end_of_word_suffix"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        self.pairs = PairTable([vocabulary[a] for a, _ in pairs], [vocabulary[b] for _, b in pairs], range(len(pairs)), [vocabulary[a + b] for a, b in pairs])
        letters = _byte_letters()
        self.inner = np.array([vocabulary[c] for c in letters], np.int32)
        self.last = np.array([vocabulary[c + end] for c in letters], np.int32)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.parts = regex.compile(split)
        self.safe = regex.compile(SAFE)
        self.special = [t["content"] for t in spec["added_tokens"]]

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids a word) of an Arrow string array without white space in its values."""
        words = words.cast(pa.large_string())
        simple = pc.extract_regex(pc.utf8_lower(words), SIMPLE)
        match = pc.and_(simple.is_valid(), pc.match_substring_regex(words, SAFE)).to_numpy(zero_copy_only=False)
        owners = [np.repeat(np.flatnonzero(match), 2)]
        pieces = (*(pc.struct_field(simple, x).filter(pa.array(match)) for x in "ab"),)
        rest_owner, rest, odd = [], [], []
        for i, word in zip(np.flatnonzero(~match).tolist(), words.filter(pa.array(~match)).to_pylist(), strict=True):
            found = self.parts.findall(word.lower()) if self.safe.fullmatch(word) and not any(x in word for x in self.special) else [" " * LONGEST]
            if any(len(p) > LONGEST // 2 for p in found):
                odd.append((i, word))
            else:
                rest_owner += [i] * len(found)
                rest += found
        encoded = pa.concat_arrays([*pieces, pa.array(rest, pa.large_string())]).dictionary_encode()
        code = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(pieces[0])
        which = np.concatenate([np.stack([code[:n], code[n : 2 * n]], 1).ravel(), code[2 * n :]])
        owners = np.concatenate([*owners, np.asarray(rest_owner, np.int64)])
        order = np.argsort(owners, kind="stable")
        owners, which = owners[order], which[order]
        raw = encoded.dictionary
        sizes = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = np.frombuffer("".join(raw.to_pylist()).encode(), np.uint8)
        symbols = self.inner[flat]
        if len(flat):
            tail = (np.cumsum(sizes) - 1)[sizes > 0]
            symbols[tail] = self.last[flat[tail]]
        ids, made = merge(self.pairs, symbols, sizes)
        starts = np.cumsum(made) - made
        counts = np.bincount(owners, made[which], len(words)).astype(np.int64) if len(owners) else np.zeros(len(words), np.int64)
        by_library = dict(zip((i for i, _ in odd), (e.ids for e in self.library.encode_batch([w for _, w in odd], add_special_tokens=False)), strict=True)) if odd else {}
        for i, e in by_library.items():
            counts[i] = len(e)
        ends = np.cumsum(counts)
        out = np.zeros(int(counts.sum()), np.int32)
        keep = np.ones(len(out), bool)
        for i, e in by_library.items():
            keep[ends[i] - counts[i] : ends[i]] = False
            out[ends[i] - counts[i] : ends[i]] = e
        out[keep] = ids[ragged(starts[which], made[which])]
        return out, counts


@functools.lru_cache(maxsize=2)
def word_end_bpe(path: str) -> WordEndBpe:
    """One per worker and file."""
    return WordEndBpe(path)

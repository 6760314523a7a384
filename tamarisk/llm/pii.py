"""Personal data, plain and disguised, with spans in the source text.

Plain: four fixed patterns. Disguised: a transducer rewrites homoglyphs, spelled
digits and at/dot disguises, keeping for every character it writes the source range
it stands for; the same patterns run on the rewritten text, and what they find is
mapped back. A disguised span counts only if it holds a rewritten character and no
plain span of its kind covers it, so plain spans always stay as they are.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm import words as W

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long"

# Spelled digits of English, French, German and Spanish.
DIGITS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

# Letters of other scripts that look like ASCII ones.
LOOKALIKES = (
    dict(zip("АВЕКМНОРСТХУІЈЅ", "ABEKMHOPCTXYIJS", strict=True))
    | dict(zip("асеорхуіјѕԁԛԝ", "aceopxyijsdqw", strict=True))
    | dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρ", "ABEZHIKMNOPTYXovp", strict=True))
    | dict.fromkeys("․•∙", ".")
    | dict.fromkeys("‐‑‒–—−", "-")
)

AT = re.compile(r"\s*[\[({<]\s*(?:at|arroba|chez|klammeraffe)\s*[\])}>]\s*|\s+(?:at|arroba|AT)\s+(?=\S+(?:\s*[\[({<]\s*(?:dot|punkt|point|punto)\s*[\])}>]|\s+(?:dot|punkt|point|punto|DOT)\s))|\s*&#64;\s*|\s*%40", re.I)
DOT = re.compile(r"\s*[\[({<]\s*(?:dot|punkt|point|punto|\.)\s*[\])}>]\s*|\s+(?:dot|punkt|point|punto)\s+", re.I)
AT_SIGN = re.compile(r"(?<=[A-Za-z0-9._%+-])(?: *[\[({<] *@ *[\])}>] *| +@ +| @(?=[A-Za-z0-9])|@ (?=[A-Za-z0-9-]+\.))")
DIGIT_RUN = re.compile(r"\b(?:%s)(?:[\s,.-]+(?:%s|[0-9]+|dot|punkt|point|punto)){3,}" % ("|".join(sorted(DIGITS, key=len, reverse=True)), "|".join(sorted(DIGITS, key=len, reverse=True))), re.I)
DIGIT_WORD = re.compile(r"\b(?:%s)\b" % "|".join(sorted(DIGITS, key=len, reverse=True)), re.I)
PLUS = re.compile(r"\bplus\s+(?=[0-9])", re.I)
_WORDS = "|".join(sorted(DIGITS, key=len, reverse=True))
_DOTS = "dot|punkt|point|punto"
#: Texts that the transducers could rewrite, found for a whole batch by one linear automaton (RE2 syntax,
#: whose white space is narrower than Python's: what it lacks counts by itself). Never narrower than they are.
SUSPECT = (
    rf"(?i)\b(?:{_WORDS})(?:[\s,.-]+(?:{_WORDS}|[0-9]+|{_DOTS})){{3}}|[\[({{<]\s*(?:at|arroba|chez|klammeraffe|{_DOTS}|\.)\s*[\])}}>]"
    rf"|\s(?:at|arroba)\s+\S+\s+(?:{_DOTS})\s|\s(?:{_DOTS})\s|&#64;|%40|[\[({{<] *@|[a-z0-9._%+-] +@|@ +[a-z0-9-]|[\x0B\x1C-\x1F\x{{85}}\x{{A0}}]|[^\x{{0}}-\x{{FF}}]|[\x{{AD}}¹²³]"
)
INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each ``@`` leftwards: what the leftmost match of the whole pattern takes, without its rescans."""
    done = last_at = 0
    for m in AT_DOMAIN.finditer(text):
        at = m.start()
        low = max(done, last_at)
        start = low + len(text[low:at].rstrip(LOCAL))
        last_at = at + 1
        if start < at:
            done = m.end()
            yield start, done


def plain(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) by start, then kind as listed."""
    found = []
    if "@" in text:
        found += [(s, 0, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


class Track:
    """A text under rewriting: for each character its source range and whether it was rewritten."""

    def __init__(self, text: str):
        self.text, self.start, self.end, self.new = text, list(range(len(text))), list(range(1, len(text) + 1)), bytearray(len(text))

    def rewrite(self, matches, to) -> None:
        text, start, end, new, at = [], [], [], bytearray(), 0
        for m in matches:
            a, b = m.span()
            out = to(m)
            text.append(self.text[at:a])
            start += self.start[at:a]
            end += self.end[at:a]
            new += self.new[at:a]
            if out and b > a:
                text.append(out)
                start += [self.start[a]] * len(out)
                end += [self.end[b - 1]] * len(out)
                new += b"\1" * len(out)
            at = b
        text.append(self.text[at:])
        self.text = "".join(text)
        self.start, self.end, self.new = start + self.start[at:], end + self.end[at:], new + self.new[at:]


@functools.lru_cache(maxsize=65536)
def lookalike(c: str) -> str:
    """The ASCII character (or digit) that a character stands in for, else itself."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    wide = unicodedata.normalize("NFKC", c)
    if len(wide) == 1 and wide.isascii():
        return wide
    digit = unicodedata.digit(c, None)
    return c if digit is None else str(digit)


def normalise(text: str) -> Track | None:
    """The rewritten text, or None where nothing in it is disguised."""
    track = Track(text)
    changed = False
    if not text.isascii():
        try:
            text.encode("latin-1")
            odd = "­" in text or any(c in text for c in "¹²³")
        except UnicodeEncodeError:
            odd = True
        if odd:
            if INVISIBLE.search(text):
                track.rewrite(INVISIBLE.finditer(track.text), lambda m: "")
                changed = True
            strange = {c for c in set(track.text) if not c.isascii() and lookalike(c) != c}
            if strange:
                pattern = re.compile("[" + "".join(map(re.escape, sorted(strange))) + "]")
                track.rewrite(pattern.finditer(track.text), lambda m: lookalike(m[0]))
                changed = True
    # an at that stands alone is told by the dot after it, so it comes first
    for pattern, sign in ((AT, "@"), (DOT, "."), (AT_SIGN, "@")):
        if pattern.search(track.text):
            track.rewrite(pattern.finditer(track.text), lambda m, sign=sign: sign)
            changed = True
    if DIGIT_RUN.search(track.text):
        track.rewrite(DIGIT_WORD.finditer(track.text), lambda m: DIGITS[m[0].lower()])
        track.rewrite(PLUS.finditer(track.text), lambda m: "+")
        changed = True
    return track if changed else None


def spans(text: str, suspect: bool = True) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """(plain spans, all spans), each (start, kind, end) by start, then kind as listed."""
    base = plain(text)
    track = normalise(text) if suspect else None
    if track is None:
        return base, base
    extra = []
    for s, kind, e in plain(track.text):
        if any(track.new[s:e]):
            a, b = track.start[s], track.end[e - 1]
            if not any(k == kind and x <= a and b <= y for x, k, y in base):
                extra.append((a, kind, b))
    both = sorted({*base, *extra}, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))
    return base, both


def batch_spans(texts: pa.Array) -> list[tuple[str, list, list]]:
    """(text, plain spans, all spans) of each; only texts that could hold any are walked in Python."""
    texts = pc.fill_null(texts, "")
    digits = pc.match_substring_regex(texts, "[0-9@]").to_pylist()
    suspects = pc.match_substring_regex(texts, SUSPECT).to_pylist()
    none: list = []
    return [(t, *spans(t, s)) if d or s else (t, none, none) for t, d, s in zip(texts.to_pylist(), digits, suspects, strict=True)]


def joined(found: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in found)


def redact(text: str, found: list[tuple[int, str, int]]) -> str:
    """Each span, widened over those it overlaps, becomes ``<kind>`` of its first."""
    out, at = [], 0
    for s, kind, e in found:
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame) -> DataFrame:
    """Spans of every whole text; counts and digest are of the plain ones.

    Null and empty text: no spans, the digest of the empty string. Equal rows give equal
    rows; an empty table an empty result; other columns are not read.
    """
    W.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, base, both in batch_spans(batch["text"]):
                counts = [sum(k == kind for _, k, _ in base) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(both), len(both) - len(base)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[c.split(" ")[0] for c in SCHEMA.split(", ")])

    return W.table(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind; other columns as they were."""

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        out = [redact(text, found) if found else text for text, _, found in batch_spans(texts)]
        return pc.if_else(texts.is_valid(), pa.array(out, pa.string()), pa.scalar(None, pa.string()))

    W.small_batches(docs.sparkSession)
    return docs.withColumn("text", clean(docs["text"]))

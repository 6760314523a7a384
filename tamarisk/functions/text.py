"""Text normalisation as column expressions; Python only where the JVM has no function.

Two profiles exist because two normalisers with different answers do: ``corpus`` for
datasets, ``runtime`` for what users type. The first is a chain of native expressions;
Unicode NFKC and HTML entities, which Spark lacks, go through one Arrow UDF, which sees
every row once: Spark evaluates a UDF before the condition around it, and the text below it again.
The second is one Arrow UDF over arrays of code points.
"""

from __future__ import annotations

import functools
import html
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Code point ranges of Arabic script, and of what counts beside it.
ARABIC = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
RATIO_DENOMINATOR = r"a-zA-Zа-яА-Я\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{4E00}-\x{9FFF}"
ZERO_WIDTH = "\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\ufeff"
INVISIBLE = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2069}\x{2028}\x{2029}\x{FEFF}\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180E}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}\x{0300}-\x{036F}\x{0483}-\x{0489}\x{1AB0}-\x{1AFF}\x{1DC0}-\x{1DFF}\x{20D0}-\x{20FF}]"
# Letters of other alphabets and of neighbouring languages, and the Arabic letter or digit that each stands for.
CONFUSABLES = {
    "а": "ا", "е": "ه", "о": "ه", "р": "ر", "с": "س", "у": "و", "х": "خ",
    "o": "ه", "a": "ا",
    "ک": "ك", "ی": "ي", "ۀ": "ه", "ە": "ه", "ھ": "ه", "ہ": "ه", "ۂ": "ه", "ة": "ه",
    "پ": "ب", "چ": "ج", "گ": "ق", "ژ": "ز", "ڤ": "ف",
    "ے": "ي", "ڵ": "ل", "ڕ": "ر", "ڎ": "د", "ڼ": "ن", "ټ": "ت", "ډ": "د", "ړ": "ر", "ڑ": "ر", "ۃ": "ة",
    "۰": "0", "۱": "1", "۲": "2", "۳": "3", "۴": "4", "۵": "5", "۶": "6", "۷": "7", "۸": "8", "۹": "9",
}
CONFUSABLE_FROM, CONFUSABLE_TO = "".join(CONFUSABLES), "".join(CONFUSABLES.values())
assert len(CONFUSABLE_FROM) == len(CONFUSABLE_TO) == len(CONFUSABLES)
ALEF_FROM, ALEF_TO = "أإآٱ", "اااا"
SUBSTITUTION_FROM, SUBSTITUTION_TO = "یکۀؤئ", "يكهوي"
SPACE = r"(?U)\s"


def where_needed(text: Column, needed, step) -> Column:
    """``step`` of the texts that a cheap test finds it in; the text is made once, as a lambda variable."""
    return F.get(F.transform(F.array(text), lambda t: F.when(needed(t), step(t)).otherwise(t)), F.lit(0))


def _composed(texts: pa.Array, unescape: bool = False) -> pa.Array:
    """NFKC of the texts that are not in it yet (Arrow's own kernel decomposes and does not compose again)."""
    texts = texts.cast(pa.string())
    out = [t if t is None or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()]
    return pa.array([html.unescape(t) if t and "&" in t else t for t in out] if unescape else out, pa.string())


@F.arrow_udf(StringType())
def _nfkc_unescape(texts: pa.Array) -> pa.Array:
    return _composed(texts, unescape=True)


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return _composed(texts)


def nfkc(text: Column, unescape: bool = False) -> Column:
    return (_nfkc_unescape if unescape else _nfkc)(text)


def strip(text: Column) -> Column:
    """Without white space (of all of Unicode) at either end."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def drop_zero_width(text: Column) -> Column:
    return F.regexp_replace(text, f"[{ZERO_WIDTH}]+", "")


def drop_links(text: Column) -> Column:
    return where_needed(text, lambda t: t.contains("http") | t.contains("www."), lambda t: F.regexp_replace(t, r"https?://(?U)\S+|www\.(?U)\S+", ""))


def drop_mentions(text: Column, unicode_words: bool = True) -> Column:
    return where_needed(text, lambda t: t.contains("@"), lambda t: F.regexp_replace(t, r"@[\p{L}\p{N}_]+" if unicode_words else r"@[A-Za-z0-9_]+", ""))


def drop_placeholders(text: Column, names: tuple[str, ...] = ("USER", "URL", "IDX", "LF"), unicode_words: bool = True) -> Column:
    """Whole words RT (in capitals) and the placeholders (in any case)."""
    word = r"\p{L}\p{N}_" if unicode_words else "A-Za-z0-9_"
    alone = lambda t: F.regexp_replace(F.regexp_replace(t, rf"(?<![{word}])RT(?![{word}])", ""), rf"(?i)(?<![{word}])(?:{'|'.join(names)})(?![{word}])", "")
    first = "".join(sorted({c for n in names for c in (n[0].upper(), n[0].lower())}))
    return where_needed(text, lambda t: t.rlike(f"[R{first}]"), alone)


def blank_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[0-9٠-٩۰-۹]", " ")


def only_arabic(text: Column, blank: bool = False) -> Column:
    """Everything that is neither white space nor Arabic script becomes a space, with ``blank`` all digits, too."""
    # no negated class: Java tests one through its interfaces, for which the threads of an executor wait for each other
    return F.regexp_replace(text, rf"(?s){'[٠-٩۰-۹]|' if blank else ''}(?![{ARABIC}]|{SPACE}).", " ")


def stitch(text: Column, both_lone: bool = False) -> Column:
    """Spaced-out letters joined: a single space before a lone letter goes.

    ``both_lone``: only where the letter before the space stands alone, too.
    """
    letter = "[ء-ي]"
    # the space comes first, so that other places are passed over at once
    before = rf"(?<=(?<!{letter}){letter}{SPACE})" if both_lone else rf"(?<={letter}{SPACE})"
    return F.regexp_replace(text, rf"(?:{SPACE}){before}(?={letter}(?!{letter}))", "")


def letters(text: Column) -> Column:
    """Alef forms, diacritics, tatweel and Persian letters to the plain ones."""
    text = F.translate(text, ALEF_FROM + SUBSTITUTION_FROM, ALEF_TO + SUBSTITUTION_TO)
    return F.regexp_replace(text, r"[\x{064B}-\x{065F}\x{0670}\x{0640}]", "")


def cap_repeats(text: Column, most: int = 2) -> Column:
    """Runs of more than ``most`` equal characters cut to ``most``."""
    return F.regexp_replace(text, rf"(?s)(.)\1{{{most},}}", "$1" * most)


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def sanitize(text: Column) -> Column:
    """Without invisible characters, variation selectors and combining marks of other scripts."""
    # the test names all of them, and some more
    return where_needed(text, lambda t: t.rlike(r"[\x{AD}\x{300}-\x{489}\x{61C}\x{1100}-\x{FFFF}]"), lambda t: F.regexp_replace(t, INVISIBLE, ""))


def fold_homoglyphs(text: Column) -> Column:
    """Look-alikes of other alphabets to Arabic letters; presentation forms go with NFKC."""
    return F.translate(sanitize(text), CONFUSABLE_FROM, CONFUSABLE_TO)


def compress_repeats(text: Column) -> Column:
    return cap_repeats(text, 1)


def strip_separators(text: Column) -> Column:
    """Signs between Arabic characters go; spaces stay."""
    return F.regexp_replace(text, r"(?<=[\x{0600}-\x{06FF}])[-_.,،/\\]+(?=[\x{0600}-\x{06FF}])", "")


def fold_variants(text: Column) -> Column:
    return F.translate(text, "ةىیۃہ", "هييهه")


def reverse_fold(text: Column) -> Column:
    return F.regexp_replace(text, "ه$", "ة")


def fold_dialect(text: Column) -> Column:
    return F.translate(text, "چڜگڤڨصثذظ", "ككققق" + "سسزض")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def normalize(text: Column, profile: str = "corpus") -> Column:
    """``corpus`` or ``runtime`` normal form; null and blank become the empty string."""
    if profile == "runtime":
        return _runtimes(text)
    if profile == "corpus":
        # line ends and tabs themselves are white space to each step that follows
        t = where_needed(nfkc(text, unescape=True), lambda t: t.contains("\\"), lambda t: F.regexp_replace(t, r"\\[ntr]", " "))
        t = drop_placeholders(drop_mentions(drop_links(drop_zero_width(t))))
        t = stitch(only_arabic(t, blank=True))
    else:
        raise ValueError(f"unknown profile: {profile}")
    return F.coalesce(collapse_spaces(cap_repeats(letters(t))), F.lit(""))


#: White space of all of Unicode, as Java's ``(?U)\\s`` has it (Python's ``\\s`` has four more).
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINKS = re.compile(rf"https?://[^{WHITE}]+|www\.[^{WHITE}]+")
MENTIONS = re.compile("@[A-Za-z0-9_]+")
RETWEETS, PLACEHOLDERS = re.compile(r"(?<![A-Za-z0-9_])RT(?![A-Za-z0-9_])"), re.compile(r"(?ai)(?<![A-Za-z0-9_])(?:USER|URL)(?![A-Za-z0-9_])")
GONE = 0x110000


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _text(codes: np.ndarray) -> str:
    return codes.astype("<u4", copy=False).tobytes().decode("utf-32-le", "surrogatepass")


def _members(char_class: str) -> np.ndarray:
    """Whether each code point is of a class, written as above."""
    point = r"(?:\\x\{([0-9A-F]+)\}|([^\\\[\]]))"
    out = np.zeros(GONE, bool)
    for first, plain, last, plain_last in re.findall(rf"{point}(?:-{point})?", char_class):
        low = int(first, 16) if first else ord(plain)
        out[low : (int(last, 16) if last else ord(plain_last) if plain_last else low) + 1] = True
    return out


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: itself without look-alikes (``GONE`` if invisible); itself or a space, which all white is; the plain letter (0 if none)."""
    same = np.arange(GONE, dtype=np.uint32)
    alike = same.copy()
    alike[list(map(ord, CONFUSABLE_FROM))] = list(map(ord, CONFUSABLE_TO))
    alike[_members(INVISIBLE)] = GONE
    arabic = np.where(_members(ARABIC) & ~_members("٠-٩۰-۹"), same, np.uint32(32)).astype(np.uint16)
    plain = np.arange(1 << 16, dtype=np.uint16)
    plain[list(map(ord, ALEF_FROM + SUBSTITUTION_FROM))] = list(map(ord, ALEF_TO + SUBSTITUTION_TO))
    plain[_members(r"\x{064B}-\x{065F}\x{0670}\x{0640}")[: 1 << 16]] = 0
    return alike, arabic, plain


def _runtime(text: str) -> str:
    """The steps of the ``runtime`` profile in their order."""
    alike, arabic, plain = _tables()
    c = alike.take(_codes(text))
    if (c == GONE).any():
        c = c[c != GONE]
    t = seen = _text(c)
    if not unicodedata.is_normalized("NFKC", t):
        t = unicodedata.normalize("NFKC", t).translate(_NO_WIDTH)
    if "http" in t or "www." in t:
        t = LINKS.sub("", t)
    if "@" in t:
        t = MENTIONS.sub("", t)
    if "R" in t or "U" in t or "u" in t:
        t = PLACEHOLDERS.sub("", RETWEETS.sub("", t))
    c = arabic.take(c if t is seen else _codes(t))
    # a space between two lone letters goes (stitch)
    blank = np.flatnonzero(c == 32)
    letter = np.zeros(len(c) + 4, bool)
    letter[2:-2] = (c >= 0x621) & (c <= 0x64A)
    c = plain.take(np.delete(c, blank[letter[blank + 1] & ~letter[blank] & letter[blank + 3] & ~letter[blank + 4]]))
    c = c[c != 0]
    # of a run of spaces one stays, of others two
    again = np.flatnonzero(c[1:] == c[:-1]) + 1
    c = np.delete(c, again[(c[again] == 32) | ((again > 1) & (c[again - 1] == c[again - 2]))])
    return c.astype("<u2", copy=False).tobytes().decode("utf-16-le").strip(" ")


_NO_WIDTH = dict.fromkeys(map(ord, ZERO_WIDTH))


@F.arrow_udf(StringType())
def _runtimes(texts: pa.Array) -> pa.Array:
    return pa.array([_runtime(t) if t else "" for t in texts.cast(pa.string()).to_pylist()], pa.string())


def count_matching(text: Column, char_class: str) -> Column:
    """How many characters are of a class: what the text loses without its runs of them (see :func:`only_arabic` on negated classes)."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{char_class}]+", ""))


def script_ratio(text: Column, numerator: str = ARABIC, denominator: str = RATIO_DENOMINATOR) -> Column:
    """Characters of one class by those of another; null where there are none of the latter."""
    return F.try_divide(count_matching(text, numerator), count_matching(text, denominator))


def is_arabic_script(text: Column, least: float = 0.5) -> Column:
    return F.coalesce(script_ratio(text) >= least, F.lit(False))


def has_arabic(text: Column, least: float = 0.5) -> Column:
    return F.coalesce(script_ratio(text, ARABIC, ARABIC + "a-zA-Z") >= least, F.lit(False))


def has_mojibake(text: Column) -> Column:
    return text.contains("\ufffd")


def length_between(text: Column, shortest: int, longest: int) -> Column:
    return F.coalesce(F.length(text).between(shortest, longest), F.lit(False))


def truncate(text: Column, n: int, mark: str = "") -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(mark))).otherwise(text)


def split_bulk(text: Column) -> Column:
    """Terms pasted with commas (of either script) or line ends between them, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(text, "[,،\n]"), lambda x: F.trim(x)), lambda x: x != ""))


def first_part(value: Column) -> Column:
    return F.split_part(value, F.lit("|"), F.lit(1))


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))

"""Arabic written in Latin letters and digits: detection and transliteration.

Detection is native. Transliteration runs over the *distinct* words of a table in an
Arrow UDF; its tables are rules handed in, with a default letter table.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How letters, letter pairs and digits are read.
LETTERS = {
    "a": "ا", "b": "ب", "t": "ت", "g": "ج", "j": "ج", "d": "د", "r": "ر", "z": "ز", "s": "س", "f": "ف", "q": "ق", "k": "ك", "l": "ل",
    "m": "م", "n": "ن", "h": "ه", "w": "و", "y": "ي", "i": "ي", "e": "ا", "o": "و", "u": "و", "p": "ب", "v": "ف", "x": "كس",
    "2": "ء", "3": "ع", "4": "ذ", "5": "خ", "6": "ط", "7": "ح", "8": "ق", "9": "ص",
    "sha": "ش", "shi": "شي", "shu": "شو", "kha": "خ", "khi": "خي", "khu": "خو", "gha": "غ", "ghi": "غي", "ghu": "غو", "tha": "ث", "dha": "ذ",
    "sh": "ش", "kh": "خ", "gh": "غ", "th": "ث", "dh": "ذ", "ch": "تش", "ou": "و", "oo": "و", "ee": "ي", "aa": "ا", "ii": "ي", "ph": "ف",
    "3a": "ع", "3e": "ع", "3i": "عي", "7a": "ح", "7e": "ح", "7i": "حي", "5a": "خ", "5e": "خ", "9a": "ص", "6a": "ط", "2a": "أ", "2i": "إ", "2o": "ؤ",
}
# Words that only stand in Arabic written this way.
MARK_WORDS = "ya|yala|w?allah|insha|7a[br]|ma3a|3ala|kos|7mar|a5|el|el-|al-|ibn|bnt|kel[bm]|shar?m|na?yek|5awal|ta7t"
MARKS = rf"(?i)(?<![A-Za-z0-9_])(?:{MARK_WORDS})(?![A-Za-z0-9_])"


def is_arabizi(text: Column) -> Column:
    bare = F.trim(F.regexp_replace(text, r"https?://\S+|www\.\S+", ""))
    found = text.rlike("[a-zA-Z]") & ~text.rlike(r"[\x{0600}-\x{06FF}]") & (F.length(bare) >= 3) & (bare.rlike("[2345679]") | bare.rlike(MARKS))
    return F.coalesce(found, F.lit(False))


def transliterator(letters: dict[str, str] | None = None):
    """One word -> its reading: at each place the longest key that fits, else the character itself."""
    table = letters or LETTERS
    keys = re.compile("|".join(map(re.escape, sorted(table, key=len, reverse=True))), re.I)
    return lambda word: keys.sub(lambda m: table[m[0].lower()], word)


def word_table(words: DataFrame, most: int = 100_000) -> dict[str, str]:
    """The readings of whole words and phrases from a table (latin, arabic); a parameter of a known, small size."""
    rows = words.select("latin", "arabic").where("latin IS NOT NULL AND arabic IS NOT NULL").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} words: join them instead")
    return {r.latin.lower(): r.arabic for r in rows}


def transliterate(text: Column, words: dict[str, str] | None = None, letters: dict[str, str] | None = None) -> Column:
    """Arabizi text word by word; whole phrases and words of ``words`` first. Other text stays."""
    known, read = {k.lower(): v for k, v in (words or {}).items()}, transliterator(letters)

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        cache: dict[str, str] = {}

        def word(w: str) -> str:
            if w not in cache:
                cache[w] = known.get(w.lower()) or read(w)
            return cache[w]

        return pa.array([None if t is None else known.get(t.lower().strip()) or " ".join(map(word, t.split())) for t in texts.to_pylist()], pa.string())

    return F.when(is_arabizi(text), run(text)).otherwise(text)

"""URL filtering: longest host-and-path rule first, else a weighted vocabulary.

The vocabulary is matched by one Aho-Corasick automaton over the whole URL. A term
counts where the characters around it are no letter or digit (ASCII). One strict
term, or ``soft_needed`` *distinct* soft terms of ``weight_needed`` together, block the URL.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (verdict, host, path) of the registered query's rules.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

# Terms that block alone, and terms with weights that block only several together.
STRICT = (
    "porn", "porno", "xxx", "hentai", "camgirls", "camgirl", "escorts", "milf", "bdsm", "fetish", "nsfw", "erotic", "erotica", "sexcam", "sexchat", "striptease", "upskirt", "onlyfans",
    "onlinecasino", "sportsbook", "betting", "roulette", "blackjack", "slots", "warez", "crackz", "serialz", "keygens", "torrents", "phishing", "carding", "malware", "ransomware",
    "viagra", "cialis", "tramadol", "xanax", "oxycodone", "paydayloan", "paydayloans",
)
SOFT = {
    "adult": 2, "amateur": 1, "babes": 2, "bet": 1, "bets": 1, "bonus": 1, "cash": 1, "casino": 2, "cheap": 1, "cheats": 1, "click": 1, "coupon": 1, "crack": 2, "cracked": 2, "credit": 1, "crypto": 1,
    "dating": 2, "deal": 1, "deals": 1, "discount": 1, "diet": 1, "download": 1, "drugs": 2, "earn": 1, "easy": 1, "escort": 2, "extreme": 1, "fast": 1, "free": 1, "gambling": 2, "girls": 2, "hack": 2, "hacked": 2,
    "hot": 1, "jackpot": 2, "keygen": 2, "kinky": 2, "live": 1, "loan": 1, "loans": 1, "lottery": 2, "lucky": 1, "money": 1, "naked": 2, "nude": 2, "offer": 1, "pharmacy": 1, "pills": 2, "pirate": 1, "poker": 2,
    "prize": 1, "promo": 1, "replica": 1, "rich": 1, "sale": 1, "serial": 1, "sex": 2, "sexy": 2, "singles": 1, "spin": 1, "steroids": 2, "teen": 2, "torrent": 2, "video": 1, "webcam": 2, "weight": 1, "win": 1, "winner": 1,
}
#: Distinct soft terms, and their weight together, that block.
SOFT_NEEDED, WEIGHT_NEEDED = 2, 3

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@functools.lru_cache(maxsize=4)
def automaton(terms: tuple[str, ...]):
    """One per worker and vocabulary: each term with its number."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for number, term in enumerate(terms):
        out.add_word(term, (number, len(term)))
    out.make_automaton()
    return out


def distinct_terms(url: str, found_by) -> set[int]:
    """Numbers of the terms that stand in an (already lower-cased) URL between boundaries."""
    found = set()
    letter = lambda c: c.isascii() and c.isalnum()
    for end, (number, size) in found_by.iter(url):
        start = end - size + 1
        if not (start and letter(url[start - 1])) and not (end + 1 < len(url) and letter(url[end + 1])):
            found.add(number)
    return found


def vocabulary_counts(strict: tuple[str, ...], soft: dict[str, int]):
    """Arrow-batched UDF: URL -> (distinct strict terms, distinct soft terms, the soft ones' weight). A term in both lists is strict."""
    terms = tuple(dict.fromkeys((*strict, *soft)))
    n_strict = len(dict.fromkeys(strict))
    weights = [0] * n_strict + [soft[t] for t in terms[n_strict:]]

    @F.pandas_udf("n_strict int, n_soft int, soft_weight int")
    def count(urls: pd.Series) -> pd.DataFrame:
        found_by, rows = automaton(terms), []
        for url in urls:
            found = distinct_terms(url, found_by) if url else ()
            n = sum(x < n_strict for x in found)
            rows.append((n, len(found) - n, sum(weights[x] for x in found)))
        return pd.DataFrame(rows, columns=["n_strict", "n_soft", "soft_weight"])

    return count


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, soft_needed: int = SOFT_NEEDED, weight_needed: int = WEIGHT_NEEDED) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_strict, n_soft, soft_weight) of every row.

    Null URL or none with ``://``: empty host and path, so no rule; the vocabulary still reads
    the URL's text (null: no terms). Repeated rows are judged each. Rules of equal length:
    the first in alphabetical order. Other columns of ``pages`` are not read.
    """
    from tamarisk.llm.words import table

    df = table(pages, "page_id", "url").select("page_id", F.col("url").cast("string").alias("url"))
    df = df.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    rule = named = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == rule_host) | F.col("host").endswith("." + rule_host)) & F.col("path").startswith(rule_path)
        rule = F.when(fits, verdict) if rule is None else rule.when(fits, verdict)
        named = F.when(fits, rule_host + rule_path) if named is None else named.when(fits, rule_host + rule_path)
    none = F.lit(None).cast("string")
    df = df.withColumn("rule", none if named is None else named).withColumn("by_rule", none if rule is None else rule)
    df = df.withColumn("v", vocabulary_counts(tuple(strict), dict(soft))(F.translate("url", UPPER, LOWER)))
    by_method = F.when((F.col("v.n_strict") >= 1) | ((F.col("v.n_soft") >= soft_needed) & (F.col("v.soft_weight") >= weight_needed)), "block").otherwise("allow")
    return df.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"), F.col("v.n_strict").cast("long").alias("n_strict"), F.col("v.n_soft").cast("long").alias("n_soft"), F.col("v.soft_weight").cast("long").alias("soft_weight"))


def oracle_sql(rules=RULES, strict=STRICT, soft=SOFT, soft_needed: int = SOFT_NEEDED, weight_needed: int = WEIGHT_NEEDED) -> str:
    """The same rows in DuckDB."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    names = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered)
    verdicts = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ordered)
    count = lambda terms: " + ".join(f"{w} * CAST(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS BIGINT)" for t, w in terms)
    once = lambda terms: [(t, 1) for t in dict.fromkeys(terms)]
    only_soft = {t: w for t, w in soft.items() if t not in strict}
    return f"""
WITH u AS (
  SELECT page_id, coalesce(translate(url, '{UPPER}', '{LOWER}'), '') AS low,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
c AS (SELECT *, {count(once(strict))} AS n_strict, {count(once(only_soft))} AS n_soft, {count(only_soft.items())} AS soft_weight FROM u)
SELECT page_id, host, path, CASE {names} END AS rule,
       coalesce(CASE {verdicts} END, CASE WHEN n_strict >= 1 OR (n_soft >= {soft_needed} AND soft_weight >= {weight_needed}) THEN 'block' ELSE 'allow' END) AS verdict,
       n_strict, n_soft, soft_weight
FROM c"""

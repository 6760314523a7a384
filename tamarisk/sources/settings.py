"""Settings as rows: validated import, export, share codes, domain gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "enabled boolean, mode string, threshold double, disabledDomains array<string>, enabledDomains array<string>, domainMode string, customWords array<struct<word:string,method:string>>, allowlist array<string>"
MODES = ("blur", "hide", "highlight")


def parse(text: Column) -> Column:
    """The known keys of a JSON settings text; an unknown mode becomes blur, a threshold outside [0, 1] null."""
    s = F.from_json(text, SCHEMA)
    return F.when(s.isNotNull(), s.withField("mode", F.when(s.mode.isin(*MODES), s.mode).otherwise("blur")).withField("threshold", F.when(s.threshold.between(0, 1), s.threshold)))


def export(settings: DataFrame, secret: tuple[str, ...] = ("pin", "pinHash", "pinSalt")) -> DataFrame:
    return settings.select(F.to_json(F.struct(*(c for c in settings.columns if c not in secret))).alias("json"))


def share_code(words: DataFrame) -> DataFrame:
    """One code (base64 of JSON) of a word list, in a fixed order."""
    return words.agg(F.base64(F.to_json(F.array_sort(F.collect_set("word"))).cast("binary")).alias("code"))


def from_share_code(codes: DataFrame, own: DataFrame) -> DataFrame:
    """The words of codes joined to one's own, each once."""
    words = codes.select(F.explode(F.from_json(F.unbase64("code").cast("string"), "array<string>")).alias("word"))
    return own.select("word").union(words).distinct()


def open_pages(pages: DataFrame, hosts: DataFrame, mode: str = "normal", host: str = "host") -> DataFrame:
    """Pages that are looked at: all but the listed hosts, or (minimal) only those."""
    return pages.join(hosts.select(host).distinct(), host, "left_semi" if mode == "minimal" else "left_anti")

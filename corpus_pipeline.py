"""From raw documents to packed training sequences, in five written stages.

Every stage takes all that the one before kept; all but the last return the columns
of ``documents``, with ``n_chars`` following the text. An empty table stays empty through all
stages, and columns besides these pass through those that return documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.llm import lines, minhash, packing, pii, quality
from tamarisk.llm.store import Scratch


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _like(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of ``docs``; the length is that of the text as it is now."""
    return out.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fertility rules keep.

    Null, empty and short texts go; repeated rows are judged each; an unknown or null language is judged by its script.
    """
    return quality.keep_good(docs, _tokenizer("piece_bpe_32k.model"), _tokenizer("word_bpe_49k.json"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that (nearly) equal an earlier one.

    A document may end up empty; null text stays null. Equal rows are one document and come out
    alike. Rows with a null doc_id come first in the order.
    """
    return _like(docs, lines.dedup_lines(docs, lines.BY_LENGTH, exact=True))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id.

    Null and empty texts and null doc_ids are in no group and stay; so do equal rows of the kept document.
    """
    gone = minhash.near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_text")).distinct()
    is_gone = (docs["doc_id"].cast("long") == F.col("gone_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("gone_text"))
    return docs.join(gone.hint("merge"), is_gone, "left_anti").select(*docs.columns)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, plain and disguised, replaced by its kind; null text stays null, every row stays."""
    return _like(docs, pii.redacted(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens; null text counts as empty, every row is packed."""
    return packing.pack(docs, _tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("pii", redaction),
    ("packing", sequences),
]

#: Vocabularies and hash sketches are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.put(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries():
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

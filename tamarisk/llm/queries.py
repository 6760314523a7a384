"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarisk.llm import packing

    return packing.pack(_documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarisk.llm import sentencepieces

    return sentencepieces.encode(_documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarisk.llm import minhash

    return minhash.near_duplicates(_documents(spark, sf_dir))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tamarisk.llm import lines

    out = lines.dedup_lines(_documents(spark, sf_dir), lines.BY_LENGTH, exact=True)
    return out.select("doc_id", "n_lines", "n_removed", "n_near", F.sha2("text", 256).alias("kept_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarisk.llm import quality

    return quality.measure(_documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model"), _tokenizer("word_bpe_49k.json"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarisk.llm import fingerprints

    return fingerprints.near_edits(_documents(spark, sf_dir))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarisk.llm import pii

    return pii.detect(_documents(spark, sf_dir))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarisk.llm import substrings

    return substrings.remove_repeats(_documents(spark, sf_dir))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarisk.llm import urls

    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarisk.llm import ngrams

    return ngrams.perplexity(_documents(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarisk.llm import audit

    return audit.audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarisk.llm import shards

    return shards.report(_documents(spark, sf_dir))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarisk.llm import manifest

    return manifest.manifest(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_minhash": op3_minhash,
        "op4_lines": op4_lines,
        "op5_quality": op5_quality,
        "op6_fingerprints": op6_fingerprints,
        "op7_pii": op7_pii,
        "op8_substrings": op8_substrings,
        "op9_urls": op9_urls,
        "op10_kneser_ney": op10_kneser_ney,
        "op11_filter_audit": op11_filter_audit,
        "op12_sharding": op12_sharding,
        "op13_manifest": op13_manifest,
    }


def oracle_sql() -> dict[str, str]:
    from tamarisk.llm import audit, manifest, urls

    return {"op9_urls": urls.oracle_sql(), "op11_filter_audit": audit.oracle_sql(), "op13_manifest": manifest.oracle_sql()}

"""Readers and writers by config: everything about a dataset is data."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from tamarisk.operators import labels, profile
from tamarisk.sources import workbook

# What a config means where it says nothing.
EXTENSIONS = (".csv", ".tsv", ".xlsx", ".parquet", ".json", ".jsonl")
DEFAULTS = {"dialect": "Unknown", "encoding": "utf-8", "separator": ",", "no_header": False}


def read_table(spark: SparkSession, path: str, separator: str = ",", encoding: str = "utf-8", columns: list[str] | None = None, strict: bool = False, no_header: bool = False, sheet: int | str = 0, json_lines: bool | None = None) -> DataFrame:
    """A raw dataset by its extension: parquet, xlsx, tsv, json, jsonl, else CSV.

    Labels and texts are read as strings. Bad lines of CSV and TSV are skipped, or fail with
    ``strict``. A directory of parquet is one table. ``json_lines`` says whether a ``.json``
    file holds a value a line (by default a ``.jsonl`` file does, a ``.json`` file doesn't).
    """
    low = path.lower().rstrip("/")
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    if low.endswith((".xlsx", ".xls")):
        return read_excel(spark, path, [sheet], columns if no_header else None)
    if low.endswith((".json", ".jsonl")):
        lines = low.endswith(".jsonl") if json_lines is None else json_lines
        return spark.read.json(path, multiLine=not lines, mode=mode)
    reader = spark.read.option("mode", mode).option("encoding", encoding).option("sep", "\t" if low.endswith(".tsv") else separator).option("quote", '"').option("escape", '"').option("multiLine", not low.endswith(".tsv"))
    if no_header:
        return reader.schema(ST.StructType([ST.StructField(c, ST.StringType()) for c in columns or ["text", "label"]])).csv(path, header=False)
    return reader.option("inferSchema", False).csv(path, header=True)


def read_excel(spark: SparkSession, path: str, sheets: list[int | str], names: list[str] | None = None) -> DataFrame:
    """Sheets of one workbook, one below the other: see :func:`workbook.read_workbook`; the old binary format, a driver-sized file, goes through pandas' engine."""
    if not path.lower().endswith(".xls"):
        return workbook.read_workbook(spark, path, sheets, names)
    import pandas as pd

    frames = [pd.read_excel(path, sheet_name=s, header=None if names else 0, names=names, dtype=str) for s in sheets]
    own = pd.concat(frames, ignore_index=True)
    schema = ST.StructType([ST.StructField(str(c), ST.StringType()) for c in own.columns])
    return spark.createDataFrame(own.astype(object).where(own.notna(), None), schema)


def read_many(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """Several files of one dataset, one below the other, columns by name; what one lacks is null."""
    if not paths:
        raise ValueError("no files given")
    out = read_table(spark, paths[0], **options)
    for path in paths[1:]:
        out = out.unionByName(read_table(spark, path, **options), allowMissingColumns=True)
    return out


def listed(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> list[str]:
    """Paths of the data files below a folder, sorted; none if there is no such folder."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    found, files = [], fs.listFiles(top, True)
    while files.hasNext():
        path = files.next().getPath().toString()
        if path.lower().endswith(extensions):
            found.append(path)
    return sorted(found)


def inspect_tree(spark: SparkSession, root: str) -> DataFrame | None:
    """:func:`profile.inspect` of every data file below a folder, with ``file``; None where there is none. Its rows are as few as the columns."""
    out = None
    for path in listed(spark, root):
        own = profile.inspect(read_table(spark, path)).select(F.lit(path).alias("file"), "*")
        out = own if out is None else out.union(own)
    return out


def read_tree(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """All parquet files below a folder, with ``file``."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).parquet(root).withColumn("file", F.input_file_name())


def read_config(path: str) -> dict[str, dict]:
    """Name -> config with defaults filled in; a missing or broken file is an empty one."""
    try:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
    except (OSError, ValueError):
        return {}
    return {k: DEFAULTS | v for k, v in raw.items()} if isinstance(raw, dict) else {}


def upsert_config(path: str, entries: dict[str, dict]) -> dict[str, dict]:
    """Entries replace those of the same name and join the others."""
    try:
        with open(path, encoding="utf-8") as f:
            old = json.load(f)
    except (OSError, ValueError):
        old = {}
    old.update(entries)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(old, f, ensure_ascii=False, indent=2)
    return old


def merge_tables(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Config tables: rows of ``new`` win over rows of ``old`` with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def load(spark: SparkSession, name: str, config: dict) -> DataFrame:
    """(text, label, source, dialect) of one configured dataset."""
    c = DEFAULTS | config
    raw = read_table(spark, c["raw_path"], c["separator"], c["encoding"], no_header=c["no_header"])
    return labels.standardize(raw, c["text_column"], c["label_column"], c["label_map"], name, c["dialect"])


def write_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """A small report as one CSV file (its rows are a sample or an aggregate)."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)

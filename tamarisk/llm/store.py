"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``.

A written table cuts lineage, is computed once, and outlives any executor.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; in a local session without one, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tamarisk-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """A folder of written tables under the shared one; ``drop`` deletes what is no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{_prefix(spark)}-{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def put(self, df: DataFrame, name: str = "t", options: dict[str, str] | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.options(**(options or {})).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def same(self, of: DataFrame, view: DataFrame) -> DataFrame:
        """A view of a written table, which dropping deletes."""
        self.paths[id(view)] = (view, self.paths.pop(id(of))[1])
        return view

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None and id(t) in self.paths:
                _delete(self.spark, self.paths.pop(id(t))[1])


def _prefix(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tamarisk-{spark.conf.get('spark.app.id', 'session')}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in fs.globStatus(p) or ():
        fs.delete(found.getPath(), True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more, which it does as the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Delete every intermediate table of this application. Results that still read one can't be used afterwards."""
    _delete(spark, f"{_prefix(spark)}-*")

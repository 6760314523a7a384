"""Where queries register themselves with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamarisk.session import small_batches

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None, longs: str = "", doubles: str = ""):
    """Registers a query with its twin; sums and literals of the twin are cast to Spark's types."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            casts = [f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()] + [f"CAST({c} AS DOUBLE) AS {c}" for c in doubles.split()]
            ORACLE[f.__name__] = f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql})" if casts else sql
        return f

    return add

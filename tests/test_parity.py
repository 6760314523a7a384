"""Every registered query of the engine against its DuckDB twin, and the contract of the entry module."""

import duckdb
import pytest

import __spark_entry__ as entry
from tamarisk.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, bool):
        return "bool", value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return "number", round(float(value), 9)
    return "text", str(value)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_twin(spark, data, duck, name):
    df = registry.QUERIES[name](spark, data)
    names = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    other = duck.sql(registry.ORACLE[name])
    assert sorted(other.columns) == names
    places = [other.columns.index(c) for c in names]
    assert mine == sorted(tuple(plain(r[i]) for i in places) for r in other.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_without_twin_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every registered query returns rows; those with SQL return the same rows as DuckDB does."""

import duckdb
import pytest

from palimpsest.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ["events", "documents", "conversations", "benchmark", "labels"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def text(value):
    return None if value is None or value != value else repr(value) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(text(r[c]) for c in columns) for r in df.collect()), key=str)
    assert rows
    if name in registry.oracle_sql():
        found = duck.sql(registry.oracle_sql()[name])
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert rows == sorted((tuple(text(x[i]) for i in at) for x in found.fetchall()), key=str)

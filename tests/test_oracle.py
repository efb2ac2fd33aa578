"""Every query with SQL gives the same rows as DuckDB (ORACLE_SF selects other data)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(row[i] for i in order)) for row in data)


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_query(spark, duck, name):
    result = entry_point.queries()[name](spark, SF)
    want = duck.execute(entry_point.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert rows(result.columns, result.collect()) == rows(columns, want.fetchall())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())

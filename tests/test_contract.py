"""Every registered query beside its SQL twin in DuckDB, on the smallest tables."""

import duckdb
import pytest
from compare import TABLES, rows_of

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
# At this size no six hours in a row have events of one type.
EMPTY = {"complete_horizons"}


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_matches_sql(spark, db, name):
    df = contract.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got or name in EMPTY
    sql = contract.oracle_sql().get(name)
    if sql is not None:
        result = db.execute(sql)
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows_of(columns, result.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() == 5

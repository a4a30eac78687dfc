"""Every registered query against its SQL in DuckDB, on the same files."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_points
from burnwatch.contract.oracle import oracle
from burnwatch.contract.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"
SQL = oracle()
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{SF_DIR}/events.parquet'")
    return connection


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((x is None, str(x)) for x in row))


def test_each_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    result = duck.execute(SQL[name])
    found = {d[0]: (i, str(d[1])) for i, d in enumerate(result.description)}
    assert columns == sorted(found)
    types = {f.name: TYPES[f.dataType.simpleString()] for f in frame.schema}
    assert types == {name: dtype for name, (_, dtype) in found.items()}
    expected = [tuple(row[found[c][0]] for c in columns) for row in result.fetchall()]
    actual = [tuple(row[c] for c in columns) for row in frame.collect()]
    assert actual, "an empty result checks nothing"
    assert ordered(actual) == ordered(expected)


def test_entry(spark):
    assert entry_points.entry(spark).count() == 10

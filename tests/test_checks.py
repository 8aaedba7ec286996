"""Every registered query against its SQL on the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from fleetlens.plans import catalog
from fleetlens.sources.fixtures import TABLES

SF_DIR = "/root/testdata/sf0.001"
QUERIES = catalog.QUERIES
CHECKS = catalog.CHECKS


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def _canonical(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(CHECKS[name])
    expected = cursor.fetchall()
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert _canonical(df.columns, [tuple(r) for r in df.collect()]) == _canonical(columns, expected)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)


def test_entry_point_has_them_all():
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(CHECKS) <= set(entry_point.oracle_sql())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0

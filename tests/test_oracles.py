"""Every registered query against its SQL twin, on the smallest given tables."""

import os

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SMALL):
        connection.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SMALL}/{name}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(item) for item in value)
    return value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda at: columns[at])
    return sorted(repr(tuple(plain(row[at]) for at in order)) for row in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    found = df.collect()
    if name not in ORACLES:
        assert found
        return
    cursor = duck.execute(ORACLES[name])
    columns = [entry[0] for entry in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, found) == rows(columns, cursor.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == [
        "query_id", "id", "lexical_score", "similarity", "rrf_score", "rank", "archive_filename", "member",
    ]
    assert found.count() > 0

"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from gradeloom.plans.registry import CHECK_SQL, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def con(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


def test_every_query_has_sql():
    assert set(CHECK_SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())
    assert set(CHECK_SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() == 15  # user ids below 15 make as many runs


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = [tuple(plain(v) for v in r) for r in df.select(*columns).collect()]
    answer = con.execute(CHECK_SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)

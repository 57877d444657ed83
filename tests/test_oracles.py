"""Every query that has SQL gives the rows that DuckDB gives on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from ctxloom import queries as core

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got, expected = core.QUERIES[name](spark, DATA), duck.sql(core.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    place = [expected.columns.index(c) for c in columns]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    a = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key)
    b = sorted((tuple(r[i] for i in place) for r in expected.fetchall()), key=key)
    assert a == b


def test_every_query_is_registered():
    assert set(core.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

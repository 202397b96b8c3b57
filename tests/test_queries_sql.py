"""Every trace query that has SQL gives the same rows as DuckDB, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from framewright import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    expected = duck.sql(catalog.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    rows = sorted((tuple(plain(r[k]) for k in at) for r in expected.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == rows

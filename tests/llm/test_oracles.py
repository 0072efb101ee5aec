"""Queries that SQL can express agree with it, on the smallest tables."""

import os

import duckdb
import pytest

from textloom.llm import queries

ORACLES = queries.oracle_sql()


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    df = queries.queries()[name](spark, sf)
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=str)
    assert sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=str) == want

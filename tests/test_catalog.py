"""Every registered query runs; where it has SQL, both give the same rows."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from textloom.plans.catalog import load

QUERIES, ORACLES = load()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v if isinstance(v, (int, str)) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    rows = [tuple(map(plain, r)) for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    place = [names.index(c) for c in df.columns]
    want = [tuple(plain(r[i]) for i in place) for r in found.fetchall()]
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_clusters_are_of_whole_turns(spark, tmp_path):
    same = "identical opening words " * 6
    rows = [(1, i, "user", same + end) for i, end in enumerate(["alpha beta"] * 5 + ["lemon 7 grapes", "lemon 8 grapes"])] + [(1, 150, "user", same + "alpha beta")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.id % (1 << 20): r.cluster for r in QUERIES["cluster_greedy"](spark, str(tmp_path)).collect()}
    assert sorted(found) == [0, 1, 2, 3, 4, 5, 6, 150] and found[150] == found[0] and found[5] != found[6]
    events = QUERIES["cluster_events"](spark, str(tmp_path)).collect()
    assert sum(r.mentions for r in events) == 8 and {len(r.text) for r in events} <= {len(same + e) for e in ("alpha beta", "lemon 7 grapes")}

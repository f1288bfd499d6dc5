"""Every query that has SQL gives the same rows as DuckDB on small tables of two sizes."""

import os

import duckdb
import pytest

from gridweave.plans.catalogue import ORACLE_SQL, QUERIES

SIZES = ("sf0.001", "sf0.01")


@pytest.fixture(scope="module", params=SIZES)
def tables(request):
    con, folder = duckdb.connect(), f"/root/testdata/{request.param}"
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(folder):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    return folder, con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return str(value) if value.__class__.__name__ in ("Decimal", "datetime") else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    folder, duck = tables
    got = QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    if name in ORACLE_SQL:
        answer = duck.sql(ORACLE_SQL[name])
        assert sorted(answer.columns) == columns
        places = [answer.columns.index(c) for c in columns]
        want = sorted((tuple(plain(r[p]) for p in places) for r in answer.fetchall()), key=str)
        assert rows == want
    assert rows

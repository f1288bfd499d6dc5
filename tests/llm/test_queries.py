"""Queries that have SQL give the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from gridweave.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    got, answer = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(answer.columns)
    assert sorted(map(tuple, got.select(answer.columns).collect()), key=str) == sorted(answer.fetchall(), key=str)

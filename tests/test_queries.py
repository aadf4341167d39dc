"""Every query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from catalume.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def test_every_query_has_sql():
    assert queries.SQL.keys() == queries.QUERIES.keys()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_its_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(f"select {', '.join(columns)} from ({queries.SQL[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(want, key=str)

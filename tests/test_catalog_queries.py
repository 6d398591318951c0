"""Every catalogue query against its DuckDB form, at the smallest size."""

import os

import duckdb
import pytest

from eventloom.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    rows = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name]).df()
        assert sorted(rows.columns) == sorted(want.columns)
        cols = sorted(want.columns)
        assert sorted(map(str, rows[cols].values.tolist())) == sorted(map(str, want[cols].values.tolist()))

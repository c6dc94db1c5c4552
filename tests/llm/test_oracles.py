"""The queries that SQL can express, against that SQL on the smallest tables."""

import os

import duckdb
import pytest

from loamwork.llm.oracles import oracle_sql
from loamwork.llm.queries import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"create view {f[:-8]} as select * from '{FOLDER}/{f}'")
    got, want = queries()[name](spark, FOLDER), con.sql(oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda columns, data: sorted(tuple(str(r[columns.index(c)]) for c in sorted(columns)) for r in data)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())

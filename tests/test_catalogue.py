"""Every catalogue query against its SQL on the smallest tables, and the driver's contract."""

import os

import duckdb
import pytest

from loamwork.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def canon(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(f"{r[k]:.5f}" if isinstance(r[k], float) else str(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"create view {f[:-8]} as select * from '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    want = duck.sql(catalogue.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_rows_only_queries_run(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

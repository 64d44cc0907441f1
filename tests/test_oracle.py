"""Every query with SQL beside it gives the same rows on Spark and on DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as app
from tests.conftest import SF_DIR
from tools.check_queries import rows

SQL = app.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = app.queries()[name](spark, SF_DIR)
    got, cols = rows([tuple(r) for r in df.collect()], df.columns)
    cur = duck.execute(SQL[name])
    want, names = rows(cur.fetchall(), [d[0] for d in cur.description])
    assert cols == names
    assert got == want


def test_entry_has_rows(spark):
    assert app.entry(spark).count() > 0

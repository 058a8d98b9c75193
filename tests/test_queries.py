"""Every query that SQL can express against DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as driver
from halocline.plans.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


def _text(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return tuple(map(_text, v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, sql, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    relation = sql.sql(ORACLE_SQL[name])
    at = [list(relation.columns).index(c) for c in columns]
    assert sorted(tuple(_text(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(_text(r[i]) for i in at) for r in relation.fetchall())


def test_entry(spark):
    assert driver.entry(spark).columns == ["point", "k", "var", "mean", "spread", "increment"]
    assert set(driver.oracle_sql()) <= set(driver.queries())

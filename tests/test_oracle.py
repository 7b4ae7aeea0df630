"""Every registered query runs; those with SQL agree with it."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check_oracle import KINDS, canon

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert got
        return
    cur = db.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    assert sorted(cols) == sorted(df.columns)
    assert {c: KINDS.get(t, t) for c, t in df.dtypes} == types
    assert canon(got, df.columns) == canon(cur.fetchall(), cols)


def test_contract(spark):
    assert set(ORACLES) <= set(QUERIES)
    rows = contract.entry(spark).collect()
    assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5]

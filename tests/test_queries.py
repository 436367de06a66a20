"""Every registered query against its SQL on the same tables."""

import glob
import os

import duckdb
import pytest

from lumenfold.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    plain = lambda v: "0.0" if isinstance(v, float) and v == 0 else str(v)
    return sorted(tuple(plain(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    rel = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, data, name):
    """Those without SQL are held against brute force in test_sequences.py; here, whole results of a fixed schema."""
    df = QUERIES[name](spark, data)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)

"""Every query has rows or a stable schema, and equals its SQL, at the smallest size."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from passage_engine.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("NULL" if x is None or x != x else str(x) for x in r) for r in frame.itertuples(index=False))


def test_entry(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        want = db.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    else:
        assert len(got) > 0

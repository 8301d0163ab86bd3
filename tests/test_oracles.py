"""Every registered query against its SQL in another engine, and shape checks of the entry module."""

import glob
import os

import pytest

import __spark_entry__ as E
from repolens.plans.registry import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query(spark, db, name):
    df = E.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    mine = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    cursor = db.execute(E.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    theirs = sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted(names) == columns
    assert mine == theirs

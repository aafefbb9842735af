"""Every registered query with SQL, against DuckDB on the smallest scale."""

import glob
import os
from decimal import Decimal

import duckdb
import pytest

from symloom.plans import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None or v != v:
        return ""
    if isinstance(v, (float, Decimal)):
        return f"{float(v):.9g}"
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_duckdb(spark, db, name):
    got, want = QUERIES[name](spark, SF), db.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_without_sql_run(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    assert QUERIES[name](spark, SF).count() > 0

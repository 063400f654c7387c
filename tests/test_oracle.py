"""Every registered query with SQL gives DuckDB's rows, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from arraymill.plans.queries import ORACLE, QUERIES

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.6g}"
    return str(v)


def rows(data, columns, order):
    at = [columns.index(c) for c in order]
    return sorted(tuple(plain(r[i]) for i in at) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    a, b = rows([tuple(r) for r in got.collect()], got.columns, order), rows(want.fetchall(), want.columns, order)
    assert len(a) == len(b)
    assert a == b


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

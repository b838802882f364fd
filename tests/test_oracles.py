"""Every query with SQL gives what DuckDB gives on the same tables; every query has rows or a stable schema."""

import os

import pytest

import __spark_entry__ as entry_point

ORACLES = entry_point.oracle_sql()


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, float):
        return "null" if x != x else f"{x:.7g}"
    return "null" if x is None else str(x)


@pytest.fixture(scope="module")
def con(small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{small}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, small, con, name):
    mine = entry_point.queries()[name](spark, small)
    theirs = con.execute(ORACLES[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(mine.columns) == sorted(columns)
    rows = sorted(tuple(plain(x) for x in r) for r in mine.select(*columns).collect())
    assert rows == sorted(tuple(plain(x) for x in r) for r in theirs.fetchall())


def test_entry_and_names(spark, small):
    assert entry_point.entry(spark).count() == 1
    assert set(ORACLES) <= set(entry_point.queries())
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5)} <= set(entry_point.queries())

"""Every query with SQL must give the rows that DuckDB gives on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SQL = oracle_sql()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5f}".replace("-0.00000", "0.00000")
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].replace("T00:00:00", "")
    return str(v)


def table(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got = queries()[name](spark, sf)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = table(got.columns, got.collect()), table(want.columns, want.fetchall())
    assert len(a) == len(b), (len(a), len(b))
    assert a == b, [(x, y) for x, y in zip(a, b, strict=True) if x != y][:3]


@pytest.mark.parametrize("name", sorted(k for k in queries() if k not in SQL and k[0] == "o" and not k.startswith("op")))
def test_query_without_sql_runs(spark, sf, name):
    assert queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0

"""Every registered query outside the optional subpackage against its SQL, at the smallest scale."""

import os

import duckdb
import pytest

from ledgersift.plans import audit_queries, data_queries

ALL = data_queries.QUERIES | audit_queries.QUERIES
SQL = data_queries.SQL | audit_queries.SQL


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return con


def plain(x):
    if x is None:
        return None
    if isinstance(x, list):
        return tuple(map(plain, x))
    if isinstance(x, bool | str):
        return x
    try:
        return round(float(x), 4)
    except (TypeError, ValueError):
        return str(x)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, data, duck, name):
    df = ALL[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    if name in SQL:
        r = duck.sql(SQL[name])
        assert sorted(r.columns) == columns
        wanted = sorted((tuple(plain(v) for v in row) for row in r.project(", ".join(f'"{c}"' for c in columns)).fetchall()), key=repr)
        assert got == wanted


def test_entry(spark):
    import __spark_entry__ as e

    assert set(ALL) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())

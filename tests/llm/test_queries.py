import os

import duckdb
import pytest

from ledgersift.llm.queries import QUERIES, SQL
from tests.conftest import rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    got = rows(df.select(*sorted(df.columns)))
    if name.endswith("_found"):
        assert len(got) == len(set(got)) > 0
    if name in SQL:
        con = duckdb.connect()
        for f in os.listdir(data):
            con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
        r = con.sql(SQL[name])
        assert sorted(tuple(x) for x in r.project(", ".join(sorted(r.columns))).fetchall()) == sorted(got)

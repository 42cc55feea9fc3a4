"""Every registered image query against the same query in SQL, at the smallest scale."""

import math
import os
from collections import Counter

import duckdb
import pytest

from voxelry.plans import queries as plans

NAMES = sorted(plans.queries())


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from '{small}/{f}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    return repr(value) if isinstance(value, (list, dict, bytes)) else value


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small, duck, name):
    df = plans.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(*columns).collect())
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = duck.sql(sql)
    assert sorted(rel.columns) == columns
    want = Counter(tuple(map(plain, r)) for r in duck.sql(f"select {', '.join(f'"{c}"' for c in columns)} from ({sql})").fetchall())
    assert sum(want.values()), "the SQL gives no rows"
    assert got == want

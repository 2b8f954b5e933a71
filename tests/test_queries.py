"""Every library query against its SQL on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from paperlake.plans import queries as library

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def normal(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(([r[i] for i in order] for r in rows), key=lambda r: [str(round(x, 6)) if isinstance(x, float) else str(x) for x in r])


@pytest.mark.parametrize("name", sorted(library.queries()))
def test_query(spark, con, name):
    got = library.queries()[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    sql = library.oracle_sql().get(name)
    if not sql:
        assert rows
        return
    want = con.sql(sql)
    assert sorted(want.columns) == sorted(got.columns)
    a, b = normal(got.columns, rows), normal(want.columns, want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(map(same, x, y)), (x, y)

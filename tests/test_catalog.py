"""Every query against its SQL, at the smallest scale."""

from __future__ import annotations

import datetime as dt
import math
import os

import pytest

from tapeforms.plans import brokerage, catalog, search, stores, streams, trading  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@pytest.fixture(scope="module")
def con():
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{SF}/{t}')")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, (float, int)) and not isinstance(x, bool):
        return f"{round(float(x), 6) + 0.0:.6f}"
    return str(x) if not isinstance(x, (dt.date, dt.datetime)) else x.isoformat()


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(columns).collect())
    result = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert sorted(names) == columns and got == want

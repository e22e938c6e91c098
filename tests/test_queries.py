"""Every query with SQL against DuckDB, on the smallest tables."""

import datetime
import decimal
import glob
import math
import os

import pytest

from lexiloom import registry

DATA = os.environ.get("LEXILOOM_TEST_DATA", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "NaN" if math.isnan(float(v)) else f"{float(v):.6f}"
    return "" if v is None else v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    r = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(tuple(plain(row[i]) for i in at) for row in r.fetchall())
    assert sorted(tuple(plain(v) for v in row) for row in df.select(*cols).collect()) == want


def test_entry():
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())

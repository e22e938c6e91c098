"""The queries with SQL against DuckDB, on the smallest tables."""

import glob
import os

import pytest

from lexiloom.llm import queries

DATA = os.environ.get("LEXILOOM_TEST_DATA", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        duck.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = queries.queries()[name](spark, DATA)
    r = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(map(str, r.fetchall()))
    got = sorted(str(tuple(x)) for x in df.select(*names).collect())
    assert got == want and want

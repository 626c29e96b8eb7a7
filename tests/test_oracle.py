"""Every core query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from lodestone.registry import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("NULL" if v is None or isinstance(v, float) and math.isnan(v) else repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        c.sql(f"create view {name.split('.')[0]} as select * from '{FOLDER}/{name}'")
    return c


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no sample tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)

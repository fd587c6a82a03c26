"""Every query with SQL against DuckDB, on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    v = float(v) if isinstance(v, decimal.Decimal) else v
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(ORACLES[name])
    found = [c[0] for c in result.description]
    assert sorted(found) == columns
    want = sorted(tuple(plain(r[found.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


def test_queries_and_oracles_have_the_same_names():
    assert set(ORACLES) <= set(entry.queries())

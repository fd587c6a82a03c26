"""Streams over a table whose files lie in no order of time give what its SQL gives."""

import time

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def backwards(spark, tmp_path_factory):
    """Conversations of 400 calls, a minute apart, in four files of which the newest calls' comes first."""
    at = str(tmp_path_factory.mktemp("calls"))
    rows = [(c, t, ("system", "user", "assistant", "user", "assistant", "user")[t], f"turno {t}") for c in range(400) for t in range(6)]
    for part in range(3, -1, -1):
        held = [r for r in rows if r[0] // 100 == part]
        spark.createDataFrame(held, "conv_id long, turn long, role string, text string").coalesce(1).write.mode("append").parquet(f"{at}/conversations.parquet")
        time.sleep(0.02)
    return at


@pytest.mark.parametrize("name", ["st9", "st9_late"])
def test_files_in_any_order_of_time(spark, backwards, name):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{backwards}/conversations.parquet/*.parquet'")
    result = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    want = sorted(map(tuple, result.fetchall()))
    assert len(want) >= 100
    assert sorted(tuple(r[c] for c in columns) for r in entry.queries()[name](spark, backwards).collect()) == want

"""Texts written as files and enumerated again, whatever is in them and in their sources' names."""

import duckdb

import __spark_entry__ as entry


def test_sc1_counts_odd_texts_and_sources(spark, tmp_path):
    texts = ["", None, "a\x01b", "\x02", "\x02n\x01\x02e", "\x020", "ñ\r\n€ \U0001f600", " "]
    sources = ["src1", "a/b c", "50%+1=ü", "", None, "n", "__HIVE_DEFAULT_PARTITION__"]
    rows = [(i * len(sources) + j, t, "es", s) for i, t in enumerate(texts) for j, s in enumerate(sources)] + [(1_000, None, "es", "only null")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1), (1, 0), (1, 1)], "doc_id long, quality long").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["sc1"]).fetchall()
    found = entry.queries()["sc1"](spark, str(tmp_path)).select("name", "files", "size_bytes").collect()
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert len(want) == len(sources) + 1

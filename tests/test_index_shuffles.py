"""Queries over the stored index shuffle little: neither words nor texts nor vectors of all chunks leave their tasks for them."""

import decimal
import random

import duckdb
import pytest

import __spark_entry__ as entry
from tidewell.operators import index as I

NAMES = ["ix4_top", "rt2", "ix2", "ev3", "jn1", "jn9", "jn13", "rt3", "rt6", "rt4", "rt5", "ev2", "ev5"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at, rng = str(tmp_path_factory.mktemp("tables")), random.Random(3)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu", "pe") for b in ("ra", "se", "ti", "vo", "zu") for c in ("bal", "cen", "dor", "fin", "gus", "hal")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = ["\n".join(say(40) for _ in range(8)) for _ in range(1_500)]
    spark.createDataFrame([(i, t, "es", f"src{i % 20}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, i % 3 % 2, 0) for i in range(1_500)], "doc_id long, quality long, toxic long").coalesce(1).write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(i, say(12)) for i in range(20)], "item_id long, text string").coalesce(1).write.parquet(f"{at}/benchmark.parquet")
    return at, sum(map(len, texts))


def plain(v):
    return float(v) if isinstance(v, decimal.Decimal) else v


def shuffled(spark) -> int:
    found = spark._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
    return sum(found.apply(i).shuffleWriteBytes() for i in range(found.size()))


@pytest.mark.parametrize("name", NAMES)
def test_a_new_index_and_its_query_shuffle_less_than_the_text(spark, tables, name):
    at, size = tables
    from tidewell.plans import retrieval as P

    P.STORED.clear()
    before = shuffled(spark)
    df = entry.queries()[name](spark, at)
    columns = df.columns
    found = sorted(map(repr, (tuple(plain(r[c]) for c in columns) for r in df.collect())))
    assert shuffled(spark) - before < 1.2 * size
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{at}/{t}.parquet/*.parquet'")
    result = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert found == sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in result.fetchall())


@pytest.mark.parametrize("weight", ["tf", "bm25"])
def test_words_and_blocks_give_the_same_answers(spark, tables, monkeypatch, weight):
    from tidewell.plans import retrieval as P

    index, asked = P.stored(spark, tables[0]), P.questions(spark, tables[0])
    monkeypatch.setattr(I, "PAIRS", 50)
    whole = sorted(map(tuple, index.top_k(asked, 5, weight).collect()))
    monkeypatch.setattr(I, "WHOLE", float("inf"))
    assert sorted(map(tuple, index.top_k(asked, 5, weight).collect())) == whole and len(whole) == 100

import ast
import pathlib

import pytest
from pyspark.sql import functions as F

from tidewell.operators import lifecycle as L
from tidewell.operators import retrieval as R
from tidewell.operators import turns as T


def test_readers_see_a_snapshot_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(LookupError):
        L.published(spark, root, "documents")
    L.publish({"documents": spark.range(3)}, root)
    # a manifest that was begun and never finished doesn't count
    (tmp_path / "manifests" / "000000000009").mkdir()
    assert L.published(spark, root, "documents").count() == 3
    (tmp_path / "manifests" / "000000000009").rmdir()
    L.publish({"documents": spark.range(5)}, root)
    assert L.published(spark, root, "documents").count() == 5


def test_forgetting_counts_once_and_reports_what_is_unknown(spark):
    docs = spark.createDataFrame([(1,), (2,)], "id long")
    chunks = spark.createDataFrame([(1,), (1,), (2,)], "document_id long")
    kept, left, audit = L.forget(spark.createDataFrame([(1,), (1,), (9,)], "id long"), docs, chunks)
    assert [r.id for r in kept.collect()] == [2] and left.count() == 1
    assert {(r.id, r.outcome, r.chunks_deleted) for r in audit.collect()} == {(1, "deleted", 2), (9, "not_found", 0)}


def test_a_bad_mark_gives_everything(spark):
    docs = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-02-01 00:00:00")], "id long, u string").select("id", F.col("u").cast("timestamp").alias("updated_at"))
    events = spark.createDataFrame([(3, "deleted", "2024-03-01 00:00:00")], "document_id long, event string, c string").select("document_id", "event", F.col("c").cast("timestamp").alias("created_at"))
    assert {r.id for r in L.since(docs, events, "nonsense").collect()} == {1, 2}
    assert {(r.id, r.change) for r in L.since(docs, events, "2024-01-15 00:00:00").collect()} == {(2, "documento"), (3, "eliminado")}


def test_unknown_ids_of_the_feed_are_reported(spark):
    listed = spark.createDataFrame([(1, "ready", 3, None)], "id long, status string, chunks long, error string")
    events = spark.createDataFrame([(1, 1, "documento", "failed", None, "x"), (2, 2, "documento", "ready", 1, None)], "id long, seq long, change string, status string, chunks long, error string")
    now, unknown = L.apply_feed(listed, events)
    assert [tuple(r) for r in now.collect()] == [(1, "failed", 3, "x")] and [r.id for r in unknown.collect()] == [2]


def test_only_one_function_joins_chunks_to_ready_documents():
    source = pathlib.Path(R.__file__).read_text()
    holders = [f.name for f in ast.parse(source).body if isinstance(f, ast.FunctionDef) and "status = 'ready'" in ast.get_source_segment(source, f)]
    assert holders == ["retrievable"]


def test_approximate_neighbours_reach_a_recall_of_nine_tenths(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["ix8"](spark, "/root/testdata/sf0.01").collect()
    assert sum(r["rank"] is not None for r in rows) / len(rows) >= 0.9


def test_a_decision_comes_a_threshold_after_the_last_voice(spark):
    frames = [(1, i, 0.9 if 5 <= i < 20 else 0.0, False) for i in range(60)]
    got = {r.kind: r for r in T.speech_events(spark.createDataFrame(frames, "stream_id long, frame_no long, prob double, agent_speaking boolean")).collect()}
    assert (got["start"].ms, got["start"].decision_ms) == (160, 256)
    assert (got["end"].ms, got["end"].decision_ms) == (640, 1280)


def test_blank_questions_and_bad_k_are_rejected(spark):
    q = spark.createDataFrame([(1, "  "), (2, " hola ")], "qid long, question string")
    assert [r.question for r in R.valid_questions(q, 4).collect()] == ["hola"]
    with pytest.raises(ValueError):
        R.valid_questions(q, 0)


EVENTS = "id long, seq long, change string, status string, chunks long, error string"


def fold(listed, events):
    """The feed's rule, event by event."""
    now, unknown = {r[0]: list(r[1:]) for r in listed}, set()
    for i, _, change, status, chunks, error in sorted(events, key=lambda e: e[1]):
        if change == "eliminado":
            now.pop(i, None)
        elif i not in now:
            unknown.add(i)
        else:
            s, c, e = now[i]
            s, c = status or s, c if chunks is None else chunks
            now[i] = [s, c, error if error is not None else e if s == "failed" else None]
    return now, unknown


def random_feed(seed, n):
    import random

    rng = random.Random(seed)
    listed = [(i, rng.choice(["ready", "failed", "parsing"]), rng.randint(0, 3), rng.choice([None, "viejo"])) for i in range(12)]
    events = [(rng.randint(0, 14), k, "eliminado" if rng.random() < 0.02 else "documento", rng.choice([None, None, "ready", "failed"]), rng.choice([None, 5, 6]), rng.choice([None, None, f"e{k}"])) for k in range(n)]
    return listed, events


@pytest.mark.parametrize("seed", range(3))
def test_the_feed_is_folded_field_by_field(spark, monkeypatch, seed):
    monkeypatch.setattr(L, "FEED_BITS", 3)  # many blocks
    listed, events = random_feed(seed, 120)
    df = spark.createDataFrame(listed, "id long, status string, chunks long, error string")
    told = spark.createDataFrame(events + events[5:9], EVENTS)  # some events twice
    now, unknown = L.apply_feed(df, told)
    want, missing = fold(listed, events)
    assert {r.id: [r.status, r.chunks, r.error] for r in now.collect()} == want and {r.id for r in unknown.collect()} == missing
    assert {r.id: [r.status, r.chunks, r.error] for r in L.apply_feed(df, told.limit(0))[0].collect()} == {r[0]: list(r[1:]) for r in listed}


def test_an_earlier_event_keeps_its_field(spark):
    listed = spark.createDataFrame([(1, "parsing", 0, None)], "id long, status string, chunks long, error string")
    events = spark.createDataFrame([(1, 1, "documento", "ready", None, None), (1, 2, "documento", None, 7, None)], EVENTS)
    assert [tuple(r) for r in L.apply_feed(listed, events)[0].collect()] == [(1, "ready", 7, None)]


def test_a_batch_of_the_feed_is_applied_once(spark, tmp_path):
    listed, events = random_feed(7, 60)
    root = str(tmp_path)
    df = spark.createDataFrame(listed, "id long, status string, chunks long, error string")
    L.publish({"listed": df, "unknown": df.select("id").limit(0)}, root)
    put = L.feed_sink(spark, root)
    for number in range(3):
        batch = spark.createDataFrame(events[number * 20 : number * 20 + 20], EVENTS)
        put(batch, number)
        put(batch, number)
        put(spark.createDataFrame(events[:20], EVENTS), 0)  # an old batch comes again
    want, missing = fold(listed, events)
    assert {r.id: [r.status, r.chunks, r.error] for r in L.published(spark, root, "listed").collect()} == want
    assert {r.id for r in L.published(spark, root, "unknown").collect()} == missing

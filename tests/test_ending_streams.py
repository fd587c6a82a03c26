"""Streams whose state ends: batches cut in any way agree, late rows go beside, state goes back to nothing."""

import datetime as dt
import json
import random
import time

import pytest

from tidewell.streaming import ending as E
from tidewell.streaming import stateful as S
from tidewell.streaming.run import files, split_late, started

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture(autouse=True)
def one_state_store(spark):
    """A batch opens a state store for each partition; these streams have a handful of keys."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def written(spark, folder, batches, schema):
    """One file a batch, in their order."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)
    return files(spark, folder)


def ran(stream, tmp_path):
    """Rows of a stream and the figures of each batch."""
    spark, out = stream.sparkSession, str(tmp_path)
    writer = stream.writeStream.format("parquet").option("path", f"{out}/out").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
    query = started(writer, spark)
    query.awaitTermination()
    states = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    return spark.read.schema(stream.schema).parquet(f"{out}/out"), states


def cuts(rows, seed):
    rng = random.Random(seed)
    rows, out = list(rows), []
    while rows:
        n = rng.randint(2, 6)
        batch, rows = rows[:n], rows[n:]
        rng.shuffle(batch)
        out.append(batch)
    return out


TURNS = "call_id long, id long, at timestamp, flagged boolean"


@pytest.mark.parametrize("seed", [0, 1])
def test_alarms_end_their_call_and_late_turns_go_beside(spark, tmp_path, seed):
    rows = [(1, 1, at(1), False), (2, 1, at(2), True), (1, 2, at(3), True), (2, 2, at(4), True), (2, 3, at(5), True), (1, 3, at(6), False), (3, 1, at(7), False), (1, 4, at(8), True)]
    # days later only a clock tick: the marks of ended calls and the silent call go
    batches = [*cuts(rows, seed), [(9, None, at(9 * 86_400), None)], [(1, 5, at(60), True)], [(9, None, at(10 * 86_400), None)]]
    stream = written(spark, str(tmp_path / "in"), batches, TURNS)
    found, states = ran(E.alarms(stream), tmp_path / "run")
    kept, late = split_late(found)
    assert sorted(map(tuple, kept.collect())) == [(1, 2, "alarm"), (1, 3, "confirmation"), (2, 1, "alarm"), (2, 2, "confirmation")]
    told = sorted((json.loads(r.late_row)["call_id"], json.loads(r.late_row)["id"]) for r in late.collect())
    assert told == [(1, 4), (1, 5), (2, 3)]  # of ended calls, the last one behind the watermark as well
    assert max(s["numRowsTotal"] for s in states) > 0 and states[-1]["numRowsTotal"] == 0


FEED = "id long, seq long, at timestamp, visible string"


@pytest.mark.parametrize("seed", [1])
def test_the_change_feed_holds_nothing_of_documents_that_are_gone(spark, tmp_path, seed):
    rows = [(1, 1, at(1), "a"), (2, 2, at(2), "a"), (1, 3, at(3), "a"), (1, 4, at(4), "b"), (2, 5, at(5), None), (2, 6, at(6), None), (2, 7, at(7), "c"), (1, 8, at(8), None), (2, 9, at(9), None)]
    found, states = ran(E.change_feed(written(spark, str(tmp_path / "in"), cuts(rows, seed), FEED)), tmp_path / "run")
    got = sorted(map(tuple, split_late(found)[0].collect()))
    assert got == [(1, 1, "documento"), (1, 4, "documento"), (1, 8, "eliminado"), (2, 2, "documento"), (2, 5, "eliminado"), (2, 7, "documento"), (2, 9, "eliminado")]
    assert states[-1]["numRowsTotal"] == 0


def test_sentences_end_with_the_turn(spark, tmp_path):
    text = "Hola a todos. ¿Cómo están? Bien, gracias. Fin"
    pieces = [text[i : i + 5] for i in range(0, len(text), 5)]
    rows = [(1, n, at(n), p, n == len(pieces) - 1) for n, p in enumerate(pieces)]
    batches = [*cuts(rows, 3), [(1, 99, at(40), "tarde", False)], [(7, None, at(9 * 86_400), None, None)], [(7, None, at(10 * 86_400), None, None)]]
    import re

    split = lambda t: S.sentence_pieces(t, lambda s: [x.strip() for x in re.split(r"(?<=[.!?])\s+(?=[A-Z¿])", s) if x.strip()])
    found, states = ran(E.sentences(written(spark, str(tmp_path / "in"), batches, "turn_id long, seq long, at timestamp, piece string, last boolean"), split), tmp_path / "run")
    kept, late = split_late(found)
    assert sorted(map(tuple, kept.collect())) == [(1, 0, "Hola a todos."), (1, 1, "¿Cómo están?"), (1, 2, "Bien, gracias."), (1, 3, "Fin")]
    assert [json.loads(r.late_row)["piece"] for r in late.collect()] == ["tarde"] and states[-1]["numRowsTotal"] == 0


@pytest.mark.parametrize("seed", [1])
def test_a_heartbeat_in_time_takes_the_timer_away(spark, tmp_path, seed):
    beats = [(1, at(0)), (2, at(10)), (1, at(60)), (1, at(120)), (2, at(71)), (3, at(100)), (1, at(500)), (3, at(160))]
    rows = sorted(beats, key=lambda b: b[1])
    batches = [*cuts(rows, seed), [(9, at(5000))], [(9, at(5001))]]
    found, states = ran(E.expired_leases(written(spark, str(tmp_path / "in"), batches, "job_id long, at timestamp"), 60_000, "10 minutes"), tmp_path / "run")
    base = int(T0.timestamp() * 1000)
    got = sorted((r.job_id, (r.expired_at_ms - base) // 1000) for r in found.collect())
    assert got == [(1, 180), (1, 560), (2, 70), (2, 131), (3, 220)]  # 60 s to the millisecond is in time, 61 s isn't
    assert states[-1]["numRowsTotal"] <= 2  # job 9's beat and timer


MESSAGES = "call_id long, seq long, kind string, body string, at timestamp"


def talk(call, turns):
    say = lambda who, text, part: json.dumps({"quien": who, "texto": text, "parcial": part})
    out = []
    for t in range(turns):
        who = "agente" if t % 2 else "paciente"
        out += [("citas", json.dumps({"citas": [f"c{t % 3}"]})), ("transcripcion", say(who, f"m{t}", True)), ("transcripcion", say(who, f"mitad {t} entera", False)), ("metricas", '{"ms": {"llm": 5}}'), ("interrupcion", '{"ms": 40}')]
    out += [("nota", '{"texto": "aviso"}'), ("bandera_roja", '{"urgencia": "urgente"}'), ("fin", '{"motivo": "completada"}')]
    return [(call, n, k, b, at(n)) for n, (k, b) in enumerate(out)]


@pytest.mark.parametrize("seed", [1])
def test_conversations_fold_alike_in_batches_streams_and_from_a_snapshot(spark, tmp_path, seed):
    rows = sorted(talk(1, 6) + talk(2, 3) + talk(3, 9), key=lambda r: r[1])
    want = sorted(map(tuple, S.folded_batch(spark.createDataFrame(rows, MESSAGES).drop("at")).collect()))
    ends = [[(1, 1000, "nota", "{}", at(50))], [(9, None, None, None, at(9 * 86_400))], [(9, None, None, None, at(10 * 86_400))]]
    found, states = ran(E.conversations(written(spark, str(tmp_path / "in"), [*cuts(rows, seed), *ends], MESSAGES)), tmp_path / "run")
    kept, late = split_late(found)
    assert sorted(map(tuple, kept.collect())) == want and late.count() == 1 and states[-1]["numRowsTotal"] == 0
    early, later = [r for r in rows if r[1] < 9], [r for r in rows if r[1] >= 9]
    going_on = E.conversations(written(spark, str(tmp_path / "in2"), cuts(later, seed), MESSAGES), spark.createDataFrame(early, MESSAGES))
    assert sorted(map(tuple, split_late(ran(going_on, tmp_path / "run2")[0])[0].collect())) == want


def test_a_message_of_a_long_call_writes_no_more_than_one_of_a_short_one(spark, tmp_path):
    rows = talk(1, 60)[:-1]
    batches = [rows[i : i + 25] for i in range(0, len(rows), 25)]
    _, states = ran(E.conversations(written(spark, str(tmp_path / "in"), batches, MESSAGES)), tmp_path / "run")
    # rows touched a batch stay the same while the state grows
    updated = [s["numRowsUpdated"] for s in states[1 : len(batches) - 1]]
    assert max(updated) <= min(updated) + 4



"""Streams over the driver's tables, each run to its end; where a batch operator gives the same rows, its SQL is the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import triage as T
from tidewell.plans import standins as S_
from tidewell.plans import triage as P
from tidewell.plans import turns as PT
from tidewell.plans.registry import query
from tidewell.streaming import ending as E
from tidewell.streaming import stateful as S
from tidewell.streaming.run import files, folder, split_late, to_end

CONFIRMED = ", nxt AS (SELECT id, lead(id) OVER (PARTITION BY call_id ORDER BY id) AS confirm_id FROM said), firsts AS (SELECT call_id, min(id) AS alarm_id FROM flagged GROUP BY 1)"
PHASES = P.sql(f"{CONFIRMED} SELECT call_id, alarm_id AS id, 'alarm' AS phase FROM firsts UNION ALL SELECT f.call_id, n.confirm_id, 'confirmation' FROM firsts f JOIN nxt n ON n.id = f.alarm_id WHERE n.confirm_id IS NOT NULL")


def spoken_stream(spark, d) -> DataFrame:
    """plans.triage.spoken as a stream; the table's files are in no order of time, so they come together."""
    c = files(spark, f"{d}/conversations.parquet", each=None)
    r = F.col("role")
    turns = c.select(F.col("conv_id").alias("call_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.timestamp_seconds(F.col("conv_id") * 60 + F.col("turn")).alias("at"), F.when(r == "user", "patient").when(r == "assistant", "agent").otherwise("system").alias("role"), F.col("text").alias("content"))
    said = F.element_at(F.array(*(F.lit(s[0]) for s in P.SENTENCES)), (F.pmod(F.col("id") + F.col("call_id"), F.lit(len(P.SENTENCES))) + 1).cast("int"))
    return turns.withColumn("content", F.when(F.col("role") == "patient", F.concat("content", F.lit(". "), said, F.lit("."))).otherwise(F.col("content")))


def _flagged(turns: DataFrame) -> DataFrame:
    """Patient turns with whether a flag fires; those that no pattern lets through don't reach the UDF."""

    @F.pandas_udf(T.FOUND)
    def detect(texts):
        return texts.map(T.detector())

    normal = T.patient_turns(turns).select("call_id", "id", "at", T.speech_normalised(F.col("content")).alias("normal"))
    hit = F.coalesce(F.rlike("normal", F.lit(T.any_rule())), F.lit(False))
    fired = normal.filter(hit).select("call_id", "id", "at", (F.size(detect("normal")) > 0).alias("flagged"))
    return fired.unionByName(normal.filter(~hit).select("call_id", "id", "at", F.lit(False).alias("flagged")))


def _triage(spark, d) -> tuple[DataFrame, DataFrame]:
    return split_late(to_end(E.alarms(_flagged(spoken_stream(spark, d)))))


@query("st9", PHASES)
def st9(spark, d) -> DataFrame:
    """Live triage: alarm and confirmation of each call from the stream of turns."""
    return _triage(spark, d)[0]


@query("st9_late", P.sql(f"{CONFIRMED} SELECT s.call_id, s.id FROM said s JOIN firsts f ON f.call_id = s.call_id JOIN nxt n ON n.id = f.alarm_id WHERE s.id > n.confirm_id"))
def st9_late(spark, d) -> DataFrame:
    """Turns of calls that had been confirmed before: they change nothing and go to a table of their own."""
    late = F.from_json("late_row", "call_id long, id long").alias("r")
    return _triage(spark, d)[1].select(late).select("r.call_id", "r.id")


@query("tr10_stream", PHASES)
def tr10_stream(spark, d) -> DataFrame:
    """The call phases alone, from a stream of turns that the batch operator has flagged."""
    turns = P.spoken(spark, d)
    summed = T.summaries(T.flags(turns)).select("id", F.lit(True).alias("hit"))
    at = folder(spark)
    T.patient_turns(turns).join(summed, "id", "left").select("call_id", "id", F.timestamp_seconds("id").alias("at"), F.coalesce("hit", F.lit(False)).alias("flagged")).repartition(4).write.parquet(at)
    return split_late(to_end(E.alarms(files(spark, at, each=100))))[0]


@query("st1_stream", PT.ST1_SQL)
def st1_stream(spark, d) -> DataFrame:
    """Turn segmentation from a stream of frames in files of neighbouring times."""
    at = folder(spark)
    PT.frames(spark, d).repartitionByRange(4, "frame_no").write.parquet(at)
    return to_end(S.speech(files(spark, at, each=100)))


@query("lc7", "WITH s AS (SELECT user_id AS id, event_id AS seq, CASE WHEN event_type <> 'error' THEN event_type END AS v FROM events), c AS (SELECT *, lag(v) OVER (PARTITION BY id ORDER BY seq) AS p FROM s) SELECT id, seq, CASE WHEN v IS NULL THEN 'eliminado' ELSE 'documento' END AS change FROM c WHERE v IS DISTINCT FROM p")
def lc7(spark, d) -> DataFrame:
    """Change feed of documents, whose visible state is the type of their user's last event; an error removes them."""
    e = files(spark, f"{d}/events.parquet", each=100)
    return split_late(to_end(E.change_feed(e.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("visible")))))[0]


#: Leases (ms) that ended before the next heartbeat, or behind the last watermark, a minute before the newest event.
LEASES = "WITH h AS (SELECT user_id AS job_id, epoch_us(ts) // 1000 AS at_ms FROM events), g AS (SELECT *, lead(at_ms) OVER (PARTITION BY job_id ORDER BY at_ms) AS nxt FROM h) SELECT job_id, at_ms + {0} AS expired_at_ms FROM g WHERE nxt - at_ms > {0} OR nxt IS NULL AND at_ms + {0} <= (SELECT max(at_ms) FROM h) - 60000"


def _leases(spark, d, lease_ms: int) -> DataFrame:
    e = files(spark, f"{d}/events.parquet", each=100)
    return to_end(E.expired_leases(e.select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("at")), lease_ms))


@query("jb3", LEASES.format(7_200_000))
def jb3(spark, d) -> DataFrame:
    """Every lease of two hours that ended without a heartbeat, by timer."""
    return _leases(spark, d, 7_200_000)


@query("jb3_timer", LEASES.format(300_000))
def jb3_timer(spark, d) -> DataFrame:
    """The same with leases of five minutes, of which most end."""
    return _leases(spark, d, 300_000)


@query("wn3_stream", S_.with_tables("traces", "SELECT id, round(quantile_cont(duration_ms, 0.95) OVER (ORDER BY id ROWS BETWEEN 4095 PRECEDING AND CURRENT ROW), 6) AS p95 FROM traces"))
def wn3_stream(spark, d) -> DataFrame:
    """The log's rolling percentile from a stream in two batches, with the last 4,096 values as state."""
    at = folder(spark)
    e = spark.read.parquet(f"{d}/events.parquet").select(F.lit(0).cast("long").alias("stream_id"), F.col("event_id").alias("id"), F.timestamp_seconds("event_id").alias("at"), F.col("value").alias("value"))
    half = e.agg(F.percentile_approx("id", 0.5).alias("h")).first().h
    for part in (e.filter(F.col("id") <= half), e.filter(F.col("id") > half)):
        part.coalesce(1).write.mode("append").parquet(at)  # a file a batch, in order
    return split_late(to_end(E.rolling(files(spark, at), 0.95, 4_096)))[0].select("id", F.round("p", 6).alias("p95"))


def messages(df: DataFrame) -> DataFrame:
    """Call messages from the conversations: each turn as a partial text, its first half, and the whole one, with metrics, citations and an end."""
    turn, call = F.col("turn"), F.col("conv_id")
    who = F.when(F.col("role") == "user", "paciente").otherwise("agente")
    whole = F.coalesce("text", F.lit(""))
    half = F.substring(whole, F.lit(1), F.ceil(F.length(whole) / 2).cast("int"))
    say = lambda text, open_: F.to_json(F.struct(who.alias("quien"), text.alias("texto"), F.lit(open_).alias("parcial")))
    cite = F.to_json(F.struct(F.array(F.concat(F.lit("c"), (turn % 3).cast("string"))).alias("citas")))
    row = lambda n, kind, body: F.struct((turn * 10 + n).alias("seq"), F.lit(kind).alias("kind"), body.alias("body"))
    rows = F.array(row(0, "citas", cite), row(1, "transcripcion", say(half, True)), row(2, "transcripcion", say(whole, False)), row(3, "metricas", F.lit('{"ms": {"llm": 5}}')), row(4, "interrupcion", F.lit('{"ms": 40}')))
    return df.select(call.alias("call_id"), F.explode(rows).alias("m")).select("call_id", "m.*")


ENDS = "SELECT conv_id AS call_id, count(*) AS utterances, 0 AS open, count(DISTINCT turn % 3) AS citations, count(*) AS interruptions, 40 * count(*) AS discarded_ms FROM conversations GROUP BY 1"


def _counted(df: DataFrame) -> DataFrame:
    return df.select("call_id", "utterances", "open", "citations", "interruptions", "discarded_ms")


def _streamed(spark, d) -> DataFrame:
    c = spark.read.parquet(f"{d}/conversations.parquet")
    ends = c.groupBy(F.col("conv_id").alias("call_id")).agg((F.max("turn") * 10 + 9).alias("seq")).select("call_id", "seq", F.lit("fin").alias("kind"), F.lit('{"motivo": "completada"}').alias("body"))
    at = folder(spark)
    messages(c).unionByName(ends).withColumn("at", F.timestamp_seconds("seq")).repartitionByRange(3, "seq").write.parquet(at)
    return split_late(to_end(E.conversations(files(spark, at, each=100))))[0]


TEXTS = "SELECT conv_id AS call_id, string_agg(CASE role WHEN 'user' THEN 'paciente' ELSE 'agente' END || ': ' || coalesce(text, ''), ' | ' ORDER BY turn) AS texts FROM conversations GROUP BY 1"


@query("st6", ENDS)
def st6(spark, d) -> DataFrame:
    """Every call's conversation folded from its messages."""
    return _counted(S.folded_batch(messages(spark.read.parquet(f"{d}/conversations.parquet"))))


@query("st6_stream", ENDS)
def st6_stream(spark, d) -> DataFrame:
    """The same from a stream of messages, each call's last one ending it."""
    return _counted(_streamed(spark, d))


@query("st6_texts", TEXTS)
def st6_texts(spark, d) -> DataFrame:
    """The whole texts of every call's folded conversation."""
    return S.folded_batch(messages(spark.read.parquet(f"{d}/conversations.parquet"))).select("call_id", "texts")


@query("st6_texts_stream", TEXTS)
def st6_texts_stream(spark, d) -> DataFrame:
    """The same from a stream of messages."""
    return _streamed(spark, d).select("call_id", "texts")


@query("st7", "SELECT conv_id * 1000 + turn AS turn_id, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS characters FROM conversations WHERE role = 'assistant'")
def st7(spark, d) -> DataFrame:
    """Agent turns cut into pieces of seven characters come out as sentences that join to the whole text."""
    import re

    cut = re.compile(r"(?<=[.!?…])\s+(?=[A-ZÀ-ÞÑ¿¡])")
    c = spark.read.parquet(f"{d}/conversations.parquet").filter("role = 'assistant'")
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    size = F.greatest(F.lit(1), F.ceil(F.length(text) / 7))
    pieces = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), text.alias("t"), size.alias("n")).withColumn("seq", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    at = folder(spark)
    pieces.select("turn_id", "seq", F.timestamp_seconds(F.col("turn_id") * 60 + F.col("seq")).alias("at"), F.substring("t", (F.col("seq") * 7 + 1).cast("int"), F.lit(7)).alias("piece"), (F.col("seq") == F.col("n") - 1).alias("last")).write.parquet(at)
    split = lambda text: S.sentence_pieces(text, lambda s: [x.strip() for x in cut.split(s) if x.strip()])
    found = split_late(to_end(E.sentences(files(spark, at, each=100), split)))[0]
    return found.groupBy("turn_id").agg((F.sum(F.length("sentence")) + F.count("*") - 1).alias("characters"))

"""Turn-taking over the events table: an event is eight frames of a user's stream, its value the loudness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators import turns as T
from tidewell.operators.views import playback_clock
from tidewell.plans import standins as S
from tidewell.plans.registry import query

FRAMES = 8
FRAMES_SQL = """frames AS (SELECT user_id AS stream_id, (rn - 1) * 8 + f AS frame_no, least(1.0, value / 60) AS prob, event_type = 'purchase' AS agent_speaking
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) CROSS JOIN range(8) r(f))"""


def speech_sql(limit: str = "640", by: str = "stream_id", source: str = "frames") -> str:
    return f"""runs AS (SELECT *, coalesce(max(CASE WHEN prob < 0.5 THEN frame_no END) OVER w, -1) AS quiet, coalesce(max(CASE WHEN prob >= 0.5 THEN frame_no END) OVER w, -1) AS voice FROM {source} WINDOW w AS (PARTITION BY {by} ORDER BY frame_no ROWS UNBOUNDED PRECEDING)),
marked AS (SELECT *, prob >= 0.5 AND (frame_no - quiet) * 32 >= 96 AS starts, (frame_no - voice) * 32 >= {limit} AND (frame_no - voice - 1) * 32 < {limit} AS ends FROM runs),
parted AS (SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY {by} ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM marked),
parts AS (SELECT {by}, part, min(CASE WHEN starts THEN (frame_no + 1) * 32 END) AS s_at, arg_min((quiet + 1) * 32, frame_no) FILTER (starts) AS s_ms, max(CASE WHEN ends THEN (frame_no + 1) * 32 END) AS e_at, max(CASE WHEN ends THEN (voice + 1) * 32 END) AS e_ms FROM parted GROUP BY ALL),
speech AS (SELECT {by}, 'start' AS kind, s_ms AS ms, s_at AS decision_ms FROM parts WHERE s_at IS NOT NULL UNION ALL SELECT {by}, 'end', e_ms, e_at FROM parts WHERE s_at IS NOT NULL AND e_at IS NOT NULL)"""


def numbered(spark, d) -> DataFrame:
    return S.read(spark, d, "events").withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))


def frames(spark, d) -> DataFrame:
    e = numbered(spark, d).withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(FRAMES - 1))))
    return e.select(F.col("user_id").alias("stream_id"), ((F.col("rn") - 1) * FRAMES + F.col("f")).cast("long").alias("frame_no"), F.least(F.lit(1.0), F.col("value") / 60).alias("prob"), (F.col("event_type") == "purchase").alias("agent_speaking"))


ST1_SQL = f"WITH {FRAMES_SQL}, {speech_sql()} SELECT stream_id, kind, ms, decision_ms FROM speech"


@query("st1", ST1_SQL)
def st1(spark, d) -> DataFrame:
    return T.speech_events(frames(spark, d))


@query("st2", f"WITH {FRAMES_SQL} SELECT stream_id, coalesce(min(frame_no * 32) FILTER (prob >= 0.5), 0) AS first_ms, coalesce(max((frame_no + 1) * 32) FILTER (prob >= 0.5), 0) AS last_ms FROM frames GROUP BY 1")
def st2(spark, d) -> DataFrame:
    return T.speech_bounds(frames(spark, d))


@query("st3", f"""WITH {FRAMES_SQL}, crossed AS (SELECT * FROM frames CROSS JOIN (VALUES {', '.join(f'({s})' for s in T.SILENCES)}) v(silence)), {speech_sql('silence', 'silence, stream_id', 'crossed')},
ends AS (SELECT silence, stream_id, count(*) AS n, arg_max(decision_ms - ms, decision_ms) AS delay FROM speech WHERE kind = 'end' GROUP BY 1, 2),
clips AS (SELECT c.silence, e.n, e.delay, CASE WHEN e.n IS NULL THEN 1 ELSE e.n - 1 END AS cuts FROM (SELECT DISTINCT silence, stream_id FROM crossed) c LEFT JOIN ends e USING (silence, stream_id))
SELECT silence, CAST(sum(cuts) AS BIGINT) AS false_cuts, count(*) FILTER (cuts > 0) AS broken, median(delay) AS median_delay FROM clips GROUP BY 1""")
def st3(spark, d) -> DataFrame:
    return T.silence_sweep(frames(spark, d)).select("silence", "false_cuts", "broken", F.col("median_delay").cast("double").alias("median_delay"))


PACKETS = "packets AS (SELECT user_id AS stream_id, event_id AS packet, epoch_us(ts) // 20000000 AS t_ms, CAST(floor(value) AS BIGINT) * 100 + 1 AS samples FROM events)"


def packets(spark, d) -> DataFrame:
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 20000000)
    return S.read(spark, d, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("packet"), t.alias("t_ms"), (F.floor("value") * 100 + 1).alias("samples"))


@query("st4", f"""WITH {PACKETS}, n AS (SELECT *, min(t_ms) OVER w AS first, sum(samples) OVER w - first_value(samples) OVER w AS seen FROM packets WINDOW w AS (PARTITION BY stream_id ORDER BY t_ms, packet ROWS UNBOUNDED PRECEDING)),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY t_ms, packet) AS rn FROM n WHERE seen * 1000 / 16000 >= 4000) WHERE rn = 1)
SELECT stream_id, round(CASE WHEN t_ms > first THEN seen * 1000.0 / (t_ms - first) ELSE 0 END, 4) AS rate, CASE WHEN t_ms > first THEN seen * 1000.0 / (t_ms - first) ELSE 0 END > 24000 AS anomaly FROM h""")
def st4(spark, d) -> DataFrame:
    return T.rate_anomalies(packets(spark, d)).withColumn("rate", F.round("rate", 4))


MARKS_SQL = f"""marks AS (SELECT user_id AS call_id, (rn - 1) // 6 AS turn, (ARRAY[{', '.join(repr(m) for m in T.MARKS)}])[(rn - 1) % 6 + 1] AS mark, epoch_us(ts) // 1000 AS t_ms FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events))"""
METRICS_SQL = f"WITH {MARKS_SQL}, m AS (SELECT call_id, turn, {', '.join(f'min(t_ms) FILTER (mark = {m!r}) AS {m}' for m in T.MARKS)} FROM marks GROUP BY 1, 2)"


def marks(spark, d) -> DataFrame:
    names = F.array(*map(F.lit, T.MARKS))
    return numbered(spark, d).select(F.col("user_id").alias("call_id"), F.floor((F.col("rn") - 1) / 6).alias("turn"), F.element_at(names, ((F.col("rn") - 1) % 6 + 1).cast("int")).alias("mark"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("t_ms"))


@query("st5", f"{METRICS_SQL} SELECT call_id, turn, turn_end - voice_end AS turn_end_ms, stt_done - turn_end AS stt_ms, llm_first - stt_done AS llm_ms, tts_first - llm_first AS tts_ms, audio_first - voice_end AS first_audio_ms, audio_first - turn_end AS after_detection_ms FROM m")
def st5(spark, d) -> DataFrame:
    return T.turn_metrics(marks(spark, d))


@query("st5_rows", f"{METRICS_SQL} SELECT * FROM (SELECT call_id, turn, 'patient' AS role, 'stt' AS stage, stt_done - turn_end AS ms FROM m UNION ALL SELECT call_id, turn, 'agent', 'llm', llm_first - stt_done FROM m UNION ALL SELECT call_id, turn, 'agent', 'tts', tts_first - llm_first FROM m UNION ALL SELECT call_id, turn, 'agent', 'total', audio_first - voice_end FROM m) WHERE ms IS NOT NULL")
def st5_rows(spark, d) -> DataFrame:
    return T.by_speaker(T.turn_metrics(marks(spark, d)))


@query("st8", "WITH m AS (SELECT user_id AS call_id, event_id AS id, CASE event_type WHEN 'click' THEN 'retrieval' WHEN 'view' THEN 'rag' WHEN 'signup' THEN 'llm_ttft' WHEN 'purchase' THEN 'tts_primera_frase' ELSE 'llm' END AS k, value FROM events) SELECT id, CASE WHEN k IN ('retrieval', 'rag') THEN value END AS retrieval, CASE WHEN k IN ('llm', 'llm_ttft') THEN value END AS llm, CASE WHEN k IN ('tts', 'tts_primera_frase') THEN value END AS tts FROM m")
def st8(spark, d) -> DataFrame:
    e = F.col("event_type")
    name = F.when(e == "click", "retrieval").when(e == "view", "rag").when(e == "signup", "llm_ttft").when(e == "purchase", "tts_primera_frase").otherwise("llm")
    maps = S.read(spark, d, "events").select(F.col("event_id").alias("id"), F.create_map(name, F.col("value")).alias("ms"))
    return maps.select("id", *(c.alias(n) for n, c in T.stage_aliases(F.col("ms")).items()))


EMITTED = "e AS (SELECT user_id AS stream_id, event_id, event_type, epoch_us(ts) // 1000 AS t, CAST(floor(value) AS BIGINT) * 30000 AS ms FROM events)"
CLOCK = "c AS (SELECT *, sum(ms) OVER w AS cum FROM e WHERE event_type IN ('click', 'view') WINDOW w AS (PARTITION BY stream_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)), pieces AS (SELECT stream_id, t, cum + max(t - (cum - ms)) OVER (PARTITION BY stream_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS until FROM c)"
BARGE = f"WITH {EMITTED}, {CLOCK}, b AS (SELECT s.stream_id, s.t, s.event_id, (SELECT max(until) FROM pieces p WHERE p.stream_id = s.stream_id AND p.t <= s.t) AS plays, (SELECT min(t) FROM e x WHERE x.stream_id = s.stream_id AND x.event_type = 'error' AND x.t >= s.t) AS cut, (SELECT min(t) FROM e x WHERE x.stream_id = s.stream_id AND x.event_type = 'purchase' AND x.t >= s.t) AS silent FROM e s WHERE s.event_type = 'signup')"


def _barge_ins(spark, d) -> DataFrame:
    e = S.read(spark, d, "events").select(F.col("user_id").alias("stream_id"), "event_id", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("t"), (F.floor("value") * 30000).alias("ms"))
    pieces = playback_clock(e.filter(F.col("event_type").isin("click", "view")), "stream_id", "t", "ms", "event_id")
    notes = e.filter(F.col("event_type").isin("error", "purchase")).withColumn("kind", F.when(F.col("event_type") == "error", "cut").otherwise("silence"))
    return T.barge_ins(pieces, e.filter("event_type = 'signup'"), notes)


@query("bi1", f"{BARGE} SELECT stream_id, t FROM b WHERE plays > t")
def bi1(spark, d) -> DataFrame:
    return _barge_ins(spark, d).select("stream_id", "t")


@query("bi2", f"{BARGE} SELECT stream_id, t, cut - t AS cut_ms, silent - t AS silence_ms, greatest(0, plays - t) AS discarded_ms FROM b WHERE plays > t")
def bi2(spark, d) -> DataFrame:
    return _barge_ins(spark, d)

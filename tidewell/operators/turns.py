"""Turn-taking from event tables: speech segments, playback, interruptions, latencies. Time is counted in frames or milliseconds
of the stream, so results don't depend on how rows arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.quantiles import exact_percentiles

FRAME_MS = 32
THRESHOLD = 0.5
START_MS, BARGE_IN_MS, SILENCE_MS = 96, 96, 640
SILENCES = (240, 320, 400, 480, 560, 640, 800, 1000)
SAMPLE_RATE, RATE_WINDOW_MS, RATE_FACTOR = 16_000, 4_000, 1.5
MARKS = ("voice_end", "turn_end", "stt_done", "llm_first", "tts_first", "audio_first")


def speech_events(frames: DataFrame, silence_ms: Column | int = SILENCE_MS, by: tuple[str, ...] = ("stream_id",), start_ms: int = START_MS, barge_in_ms: int = BARGE_IN_MS) -> DataFrame:
    """kind (start, end), ms, decision_ms of the speech in frames (by, frame_no from 0 without gaps, prob, agent_speaking).

    Speech begins after start_ms of voice in a row (barge_in_ms while the agent speaks), dated at its first frame; it ends after
    silence_ms without voice, dated at the last voice. A silence reaches its limit once; the frames between two such ends
    hold at most one beginning, the first run of voice that is long enough.
    """
    w = Window.partitionBy(*by).orderBy("frame_no").rowsBetween(Window.unboundedPreceding, 0)
    voiced = F.col("prob") >= THRESHOLD
    silence = F.lit(silence_ms) if isinstance(silence_ms, int) else silence_ms
    runs = frames.withColumns({"_quiet": F.coalesce(F.max(F.when(~voiced, F.col("frame_no"))).over(w), F.lit(-1)), "_voice": F.coalesce(F.max(F.when(voiced, F.col("frame_no"))).over(w), F.lit(-1))})
    runs = runs.withColumns({"_voiced_ms": (F.col("frame_no") - F.col("_quiet")) * FRAME_MS, "_silent_ms": (F.col("frame_no") - F.col("_voice")) * FRAME_MS})
    needed = F.when(F.col("agent_speaking"), barge_in_ms).otherwise(start_ms)
    ends = (F.col("_silent_ms") >= silence) & (F.col("_silent_ms") - FRAME_MS < silence)
    marked = runs.withColumns({"_starts": voiced & (F.col("_voiced_ms") >= needed), "_ends": ends})
    before = Window.partitionBy(*by).orderBy("frame_no").rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("_part", F.coalesce(F.sum(F.col("_ends").cast("int")).over(before), F.lit(0)))
    now = (F.col("frame_no") + 1) * FRAME_MS
    parts = marked.groupBy(*by, "_part").agg(
        F.min(F.when(F.col("_starts"), F.struct(now.alias("at"), (now - F.col("_voiced_ms")).alias("ms")))).alias("s"),
        F.max(F.when(F.col("_ends"), F.struct(now.alias("at"), (now - F.col("_silent_ms")).alias("ms")))).alias("e"),
    )
    parts = parts.filter("s is not null").withColumn("events", F.array(F.struct(F.lit("start").alias("kind"), F.col("s.ms").alias("ms"), F.col("s.at").alias("decision_ms")), F.struct(F.lit("end").alias("kind"), F.col("e.ms").alias("ms"), F.col("e.at").alias("decision_ms"))))
    return parts.select(*by, F.explode("events").alias("x")).select(*by, "x.*").filter("ms is not null")


def speech_bounds(frames: DataFrame) -> DataFrame:
    """First and last voiced moment of each stream; 0 where there is none."""
    voiced = F.col("prob") >= THRESHOLD
    first, last = F.min(F.when(voiced, F.col("frame_no") * FRAME_MS)), F.max(F.when(voiced, (F.col("frame_no") + 1) * FRAME_MS))
    return frames.groupBy("stream_id").agg(F.coalesce(first, F.lit(0)).alias("first_ms"), F.coalesce(last, F.lit(0)).alias("last_ms"))


def silence_sweep(frames: DataFrame, silences: tuple[int, ...] = SILENCES) -> DataFrame:
    """For each limit: false cuts (ends beyond the first, or one for none), clips broken so, median delay of the last end."""
    spark = frames.sparkSession
    limits = spark.createDataFrame([(s,) for s in silences], "silence int")
    crossed = frames.join(F.broadcast(limits), F.lit(True))  # eight rows
    found = speech_events(crossed, F.col("silence"), ("silence", "stream_id")).filter("kind = 'end'")
    ends = found.groupBy("silence", "stream_id").agg(F.count("*").alias("n"), F.max_by(F.col("decision_ms") - F.col("ms"), "decision_ms").alias("delay"))
    clips = frames.select("stream_id").distinct().join(F.broadcast(limits), F.lit(True)).join(ends, ["silence", "stream_id"], "left")
    cuts = F.when(F.col("n").isNull(), 1).otherwise(F.col("n") - 1)
    return clips.groupBy("silence").agg(F.sum(cuts).alias("false_cuts"), F.count_if(cuts > 0).alias("broken"), F.median("delay").alias("median_delay"))


def rate_anomalies(packets: DataFrame) -> DataFrame:
    """stream_id, rate, anomaly: samples a second once RATE_WINDOW_MS of audio has come after the first packet; judged once."""
    w = Window.partitionBy("stream_id").orderBy("t_ms", "packet").rowsBetween(Window.unboundedPreceding, 0)
    n = packets.withColumns({"first": F.min("t_ms").over(w), "all": F.sum("samples").over(w), "head": F.first("samples").over(w)})
    seen = n.withColumn("seen", F.col("all") - F.col("head")).filter(F.col("seen") * 1000 / SAMPLE_RATE >= RATE_WINDOW_MS)
    hit = seen.groupBy("stream_id").agg(F.min_by(F.struct("seen", (F.col("t_ms") - F.col("first")).alias("elapsed")), F.struct("t_ms", "packet")).alias("h"))
    rate = F.when(F.col("h.elapsed") > 0, F.col("h.seen") * 1000 / F.col("h.elapsed")).otherwise(0.0)
    return hit.select("stream_id", rate.alias("rate"), (rate > SAMPLE_RATE * RATE_FACTOR).alias("anomaly"))


def turn_metrics(marks: DataFrame) -> DataFrame:
    """Milliseconds of each stage of a turn from its marks (call_id, turn, mark, t_ms)."""
    at = {m: F.min(F.when(F.col("mark") == m, F.col("t_ms"))).alias(m) for m in MARKS}
    t = marks.groupBy("call_id", "turn").agg(*at.values())
    d = lambda a, b: F.col(a) - F.col(b)
    return t.select("call_id", "turn", d("turn_end", "voice_end").alias("turn_end_ms"), d("stt_done", "turn_end").alias("stt_ms"), d("llm_first", "stt_done").alias("llm_ms"), d("tts_first", "llm_first").alias("tts_ms"), d("audio_first", "voice_end").alias("first_audio_ms"), d("audio_first", "turn_end").alias("after_detection_ms"))


def by_speaker(metrics: DataFrame) -> DataFrame:
    """Recognition belongs to the patient's turn, the rest to the agent's."""
    return metrics.select("call_id", "turn", F.expr("stack(4, 'patient', 'stt', stt_ms, 'agent', 'llm', llm_ms, 'agent', 'tts', tts_ms, 'agent', 'total', first_audio_ms) as (role, stage, ms)")).filter("ms is not null")


def barge_ins(pieces: DataFrame, starts: DataFrame, marks: DataFrame) -> DataFrame:
    """Speech that starts while audio still plays, and what it costs.

    pieces: stream_id, t, until (playback clock); starts: stream_id, t; marks: stream_id, t, kind (cut, silence). The latest
    playback end before a start comes from one ordered pass over both, so no range join is needed; so does the next mark.
    """
    rows = pieces.select("stream_id", "t", F.lit(0).alias("o"), "until", F.lit(None).cast("string").alias("kind")).unionByName(starts.select("stream_id", "t", F.lit(1).alias("o"), F.lit(None).cast("long").alias("until"), F.lit("start").alias("kind"))).unionByName(marks.select("stream_id", "t", F.lit(2).alias("o"), F.lit(None).cast("long").alias("until"), "kind"))
    back = Window.partitionBy("stream_id").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("stream_id").orderBy("t", "o").rowsBetween(0, Window.unboundedFollowing)
    following = lambda k: F.first(F.when(F.col("kind") == k, F.col("t")), ignorenulls=True).over(ahead)
    full = rows.withColumns({"plays": F.max("until").over(back), "cut": following("cut"), "silent": following("silence")})
    hit = full.filter((F.col("kind") == "start") & (F.col("plays") > F.col("t")))
    return hit.select("stream_id", "t", (F.col("cut") - F.col("t")).alias("cut_ms"), (F.col("silent") - F.col("t")).alias("silence_ms"), F.greatest(F.lit(0), F.col("plays") - F.col("t")).alias("discarded_ms"))


ALIASES = {"retrieval": ("retrieval", "rag"), "llm": ("llm", "llm_ttft"), "tts": ("tts", "tts_primera_frase")}


def stage_aliases(latencies: Column) -> dict[str, Column]:
    """One column for each stage from a map that may call it by either name."""
    return {stage: F.coalesce(*(F.try_element_at(latencies, F.lit(n)) for n in names)) for stage, names in ALIASES.items()}


def scenario_medians(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """Medians of the metrics, runs with a detection, and runs, for each (scenario, variant)."""
    key = ["scenario", "variant"]
    out = runs.groupBy(*key).agg(F.count_if("detected").alias("detections"), F.count("*").alias("n"))
    for m in metrics:
        found = exact_percentiles(runs, key, m, [0.5]).select(F.col("scenario").alias("_s"), F.col("variant").alias("_v"), F.col("p0").alias(m))
        out = out.join(found, F.col("scenario").eqNullSafe(F.col("_s")) & F.col("variant").eqNullSafe(F.col("_v"))).drop("_s", "_v")
    return out.select(*key, *metrics, "detections", "n")

"""Relational views of patients, calls and documents: listings, worklists, roll-ups."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.quantiles import exact_percentiles

MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
CALL_STATUS = {"active": "en_curso", "completed": "completada", "escalated": "completada", "failed": "interrumpida"}
ROLES = {"agent": "agente", "patient": "paciente", "system": "sistema"}
INGEST_STATES = ("uploaded", "parsing", "chunking", "embedding", "ready")


def relabel(value: Column, labels: dict[str, str], default: str | None = None) -> Column:
    """A label for each known value."""
    out = F.when(F.lit(False), F.lit(""))
    for k, v in labels.items():
        out = out.when(value == k, v)
    return out.otherwise(F.lit(default) if default is not None else value)


def document_listing(docs: DataFrame, status: str | None, text: str | None, limit: int, offset: int) -> DataFrame:
    """Newest documents first with the count of all that match, which a page past the end still carries."""
    found = docs
    if status is not None:
        found = found.filter(F.col("status") == status)
    if text is not None:
        found = found.filter(F.col("filename").ilike(f"%{text}%") | F.coalesce("title", F.lit("")).ilike(f"%{text}%"))
    # not a window over all rows: the count is one row beside the page's
    page = found.select("id", "filename", "status").orderBy(F.desc("id")).offset(offset).limit(limit)
    return found.agg(F.count("*").alias("total")).join(page, F.lit(True), "left")


def preview(chunks: DataFrame, rows: int = 3, chars: int = 200) -> DataFrame:
    """First chunks of each document as excerpts."""
    w = Window.partitionBy("document_id").orderBy("ordinal")
    return chunks.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= rows).select("document_id", "ordinal", F.substring("content", 1, chars).alias("excerpt"))


def human_bytes(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(F.floor(n / 1024).cast("string"), F.lit(" KB"))).otherwise(F.concat(F.floor(n / (1024 * 1024)).cast("string"), F.lit(" MB")))


def human_duration(seconds: Column) -> Column:
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit(" s"))).otherwise(F.concat(F.floor(seconds / 60).cast("string"), F.lit(" min "), (seconds % 60).cast("string"), F.lit(" s")))


def clock(seconds: Column) -> Column:
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))


def date_in_words(day: Column) -> Column:
    names = F.array(*map(F.lit, MONTHS))
    return F.concat_ws(" de ", F.dayofmonth(day).cast("string"), F.element_at(names, F.month(day)), F.year(day).cast("string"))


def days_since_label(days: Column) -> Column:
    return F.when(days == 0, "hoy").when(days == 1, "ayer").otherwise(F.concat(F.lit("hace "), days.cast("string"), F.lit(" días")))


def ingest_progress(status: Column, embedded: Column, chunks: Column) -> tuple[Column, Column]:
    """Step of the state in its sequence (0 for states outside it) and share embedded."""
    step = F.array_position(F.array(*map(F.lit, INGEST_STATES)), status)
    return step, F.when(chunks > 0, F.least(F.lit(1.0), embedded / chunks)).otherwise(0.0)


def latest(df: DataFrame, by: str, *order: Column) -> DataFrame:
    """The first row of each group in the order given."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter("_rn = 1").drop("_rn")


def latest_surgery(surgeries: DataFrame) -> DataFrame:
    return latest(surgeries, "patient_id", F.desc("performed_at"), F.desc("id"))


def active_medications(meds: DataFrame, surgeries: DataFrame, asof: str) -> DataFrame:
    """Medications that run at the day asof, with their patient."""
    live = meds.filter(F.col("active") & (F.col("ends_on").isNull() | (F.col("ends_on") >= F.to_date(F.lit(asof)))))
    return live.join(surgeries.select(F.col("id").alias("surgery_id"), "patient_id"), "surgery_id")


def next_appointment(appointments: DataFrame, now: str) -> DataFrame:
    """Earliest scheduled appointment of each patient from now on, with its place."""
    ahead = appointments.filter((F.col("status") == "scheduled") & (F.col("scheduled_at") >= F.lit(now).cast("timestamp")))
    return ahead.groupBy("patient_id").agg(F.min_by(F.struct("scheduled_at", "location"), F.struct("scheduled_at", "id")).alias("n")).select("patient_id", "n.*")


def worklist(patients: DataFrame, surgeries: DataFrame, meds: DataFrame, appointments: DataFrame, calls: DataFrame, now: str) -> DataFrame:
    """Patients with their latest surgery, most recent first; every other side is reduced to one row a patient first."""
    last = latest_surgery(surgeries).select("patient_id", "procedure_name", "performed_at")
    counts = active_medications(meds, surgeries, now).groupBy("patient_id").agg(F.count("*").alias("medications"))
    ahead = next_appointment(appointments, now).select("patient_id", F.col("scheduled_at").alias("next_appointment"))
    recent = calls.groupBy("patient_id").agg(F.max("started_at").alias("last_call"))
    out = patients.join(last, patients.id == last.patient_id).drop("patient_id")
    for side in (counts, ahead, recent):
        out = out.join(side, out.id == side.patient_id, "left").drop("patient_id")
    return out.select("id", "full_name", "procedure_name", "performed_at", F.datediff(F.to_date(F.lit(now)), "performed_at").alias("days_since"), F.coalesce("medications", F.lit(0)).alias("medications"), "next_appointment", "last_call")


def call_history(calls: DataFrame, patients: DataFrame, surgeries: DataFrame, turns: DataFrame, now: str) -> DataFrame:
    last = latest_surgery(surgeries).select(F.col("patient_id").alias("pid"), "procedure_name")
    counted = turns.groupBy("call_id").agg(F.count("*").alias("turns"))
    names = patients.select(F.col("id").alias("pid2"), "full_name")
    out = calls.join(names, F.col("patient_id") == F.col("pid2"), "left").join(last, F.col("patient_id") == F.col("pid"), "left").join(counted, F.col("id") == F.col("call_id"), "left")
    ended = F.coalesce("ended_at", F.lit(now).cast("timestamp"))
    seconds = F.unix_timestamp(ended) - F.unix_timestamp("started_at")
    return out.select("id", "full_name", "procedure_name", "status", F.coalesce("turns", F.lit(0)).alias("turns"), seconds.alias("duration_s"))


def call_detail(turns: DataFrame) -> DataFrame:
    """One row a call: its turns in order with 1-based ordinals."""
    numbered = turns.withColumn("ordinal", F.row_number().over(Window.partitionBy("call_id").orderBy("id")))
    return numbered.groupBy("call_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "role", "content"))).alias("turns"))


def identity_check(claimed: Column, stored: Column, strict: bool = True) -> Column:
    """Do the digits agree? Not strict: either may contain the other."""
    a, b = F.regexp_replace(claimed, "[^0-9]", ""), F.regexp_replace(stored, "[^0-9]", "")
    equal = (a == b) & (a != "")
    return equal if strict else (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def upload_decisions(batch: DataFrame, catalog: DataFrame) -> DataFrame:
    """new, new_version or conflict for each upload by its digest; of equal uploads in the batch the first goes ahead."""
    known = catalog.groupBy("sha256").agg(F.max(F.col("status").isin(*INGEST_STATES[:-1])).alias("in_flight"), F.max(F.when(F.col("status") == "ready", F.col("id"))).alias("supersedes_id"))
    first = F.row_number().over(Window.partitionBy("sha256").orderBy("upload_id"))
    out = batch.withColumn("rn", first).join(known, "sha256", "left")
    decision = F.when((F.col("rn") > 1) | F.coalesce("in_flight", F.lit(False)), "conflict").when(F.col("supersedes_id").isNotNull(), "new_version").otherwise("new")
    out = out.withColumn("decision", decision)
    return out.select("upload_id", "decision", F.when(F.col("decision") == "new_version", F.col("supersedes_id")).alias("supersedes_id"))


#: Aliases that every task holds as one automaton at most; more meet the pieces of names in a join.
MOST_ALIASES = 200_000


def first_alias(name: Column, aliases: list[tuple[str, str, int]]) -> Column:
    """Tag of the alias (alias, tag, priority) of least priority that the name contains, then of least tag; null without one.

    All aliases are one automaton, built once a task, which reads each different name of a batch once.
    """
    shared = SparkContext.getOrCreate().broadcast(aliases)

    @F.pandas_udf("string")
    def tags(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        best: dict[str, tuple[int, str]] = {}
        for alias, tag, priority in shared.value:
            best[alias] = min(best.get(alias, (priority, tag)), (priority, tag))
        everywhere = [best.pop("")] if "" in best else []
        automaton = ahocorasick.Automaton()
        for alias, value in best.items():
            automaton.add_word(alias, value)
        automaton.make_automaton()

        def tag(text: str) -> str | None:
            found = automaton.iter(text) if best and text else ()
            return min([v for _, v in found] + everywhere, default=(0, None))[1]

        for names in batches:
            known = {n: tag(n) for n in names.dropna().unique()}
            yield names.map(known).astype(object).where(names.notna(), None)

    return tags(name)


def alias_matches(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, by_alias of distinct names (name) for any number of aliases: pieces of names as long as some alias are joined to them."""
    longest = names.agg(F.max(F.length("name"))).first()[0] or 0
    sizes = [r.n for r in aliases.select(F.length("alias").alias("n")).filter(F.col("n") <= longest).distinct().collect()]
    if not sizes:
        return names.limit(0).select("name", F.lit(None).cast("string").alias("by_alias"))
    fitting = F.filter(F.array(*map(F.lit, sizes)), lambda n: n <= F.length("name"))
    pieces = F.flatten(F.transform(fitting, lambda n: F.transform(F.sequence(F.lit(1), F.length("name") - n + 1), lambda i: F.substring(F.col("name"), i, n))))
    found = names.select("name", F.explode(F.array_distinct(pieces)).alias("alias")).join(aliases, "alias")
    return found.groupBy("name").agg(F.min(F.struct("priority", "alias_tag"))["alias_tag"].alias("by_alias"))


def resolve_protocol(calls: DataFrame, aliases: DataFrame, tags: list[str]) -> DataFrame:
    """protocol: a known tag, else that of the first alias that the procedure contains, else the raw tag.

    Aliases or priorities that are null match nothing, an empty alias is in every name but a null one.
    """
    usable = aliases.filter("alias is not null and alias_tag is not null and priority is not null").select("alias", "alias_tag", "priority")
    known = F.col("tag").isin(*tags)
    if usable.count() <= MOST_ALIASES:
        name = F.when(~F.coalesce(known, F.lit(False)), F.lower("procedure_name"))
        found = calls.select("id", "tag", first_alias(name, [tuple(r) for r in usable.collect()]).alias("by_alias"))
    else:
        named = calls.select("id", "tag", F.lower("procedure_name").alias("name"))
        found = named.join(alias_matches(named.select("name").filter("name is not null").distinct(), usable), "name", "left")
    return found.select("id", F.when(known, F.col("tag")).otherwise(F.coalesce("by_alias", "tag")).alias("protocol"))


def survey_answers(answers: DataFrame) -> DataFrame:
    """The last answer to each key of a call wins."""
    return answers.groupBy("call_id", "key").agg(F.max_by("value", "turn").alias("value"))


def as_maps(answers: DataFrame) -> DataFrame:
    return answers.groupBy("call_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("survey"))


def close_status(closes: DataFrame) -> DataFrame:
    """Final status of each call from its first close; an escalated call stays escalated."""
    first = closes.groupBy("call_id").agg(F.min_by("reason", "id").alias("reason"), F.bool_or("escalated").alias("escalated"))
    status = F.when(F.col("escalated") | (F.col("reason") == "escalada"), "escalated").when(F.col("reason") == "completada", "completed").otherwise("failed")
    return first.select("call_id", status.alias("status"))


def span_percentiles(traces: DataFrame) -> DataFrame:
    """Exact percentiles of each span, few and large groups that no task holds."""
    counts = traces.groupBy("span").agg(F.count("*").alias("rows"))
    found = exact_percentiles(traces, ["span"], "duration_ms", [0.5, 0.95]).withColumnRenamed("span", "_span")
    return counts.join(found, F.col("span").eqNullSafe(F.col("_span"))).select("span", F.col("p0").alias("p50"), F.col("p1").alias("p95"), F.col("rows").alias("n"))


def end_to_end(traces: DataFrame) -> DataFrame:
    """Sum of the stages' percentiles beside the percentile of the calls' sums."""
    staged = span_percentiles(traces).agg(F.sum("p50").alias("sum_p50"), F.sum("p95").alias("sum_p95"))
    total = exact_percentiles(traces.groupBy("call_id").agg(F.sum("duration_ms").alias("total")), [], "total", [0.5, 0.95])
    return staged.crossJoin(total.select(F.col("p0").alias("true_p50"), F.col("p1").alias("true_p95")))  # one row each


def stage_medians(traces: DataFrame) -> DataFrame:
    clean = traces.filter(F.col("duration_ms").isNotNull() & ~F.isnan("duration_ms"))
    return clean.groupBy("call_id", "span").agg(F.median("duration_ms").alias("median_ms"))


def last_stage_values(traces: DataFrame) -> DataFrame:
    """Most recent value of each stage, their sum, and the share of the longest (400 ms at least)."""
    last = traces.groupBy("call_id", "span").agg(F.max_by("duration_ms", "id").alias("last_ms"))
    w = Window.partitionBy("call_id")
    scale = F.greatest(F.lit(400.0), F.max("last_ms").over(w))
    return last.select("call_id", "span", "last_ms", F.sum("last_ms").over(w).alias("total_ms"), F.least(F.lit(1.0), F.col("last_ms") / scale).alias("share"))


def corpus_summary(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    counts = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("chunks"))
    status = F.col("status")
    return docs.join(counts, "id", "left").agg(
        F.count_if(status == "ready").alias("ready"), F.count_if(~status.isin("ready", "failed", "superseded")).alias("in_progress"), F.count_if(status == "failed").alias("failed"),
        F.sum(F.when(status == "ready", F.coalesce("chunks", F.lit(0))).otherwise(0)).alias("ready_chunks"), F.count("*").alias("total"),
    )


def playback_clock(emitted: DataFrame, by: str, t: str, ms: str, order: str) -> DataFrame:
    """until: when the audio sent so far has played, each piece after the one before it and not before it was sent.

    until_i = cum_i + max over j <= i of (t_j - cum_{j-1}), so two running windows do what a loop would.
    """
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    cum = emitted.withColumn("_cum", F.sum(ms).over(w))
    return cum.withColumn("until", F.col("_cum") + F.max(F.col(t) - (F.col("_cum") - F.col(ms))).over(w)).drop("_cum")

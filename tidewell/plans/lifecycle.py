"""Lifecycle and backlog over the driver's tables: events are document events and jobs, labels give states."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import lifecycle as L
from tidewell.plans import standins as S
from tidewell.plans.registry import query
from tidewell.plans.standins import ASOF_EVENT, with_tables
from tidewell.streaming.run import files

def now():
    return F.lit(ASOF_EVENT).cast("timestamp")


def root(spark: SparkSession) -> str:
    """A new folder under the shared one; a temporary one only where none is named."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{shared.rstrip('/')}/corpus-{uuid.uuid4().hex}"


def document_events(spark, d) -> DataFrame:
    return S.traces(spark, d).select(F.col("call_id").alias("document_id"), "id", F.col("span").alias("event"), "created_at", "duration_ms")


def jobs(spark, d) -> DataFrame:
    """Each event as a job: its type is the state, its value the attempts and the wait."""
    status = F.when(F.col("span").isin("click", "view"), "queued").when(F.col("span") == "purchase", "running").otherwise("done")
    return S.traces(spark, d).select("id", F.col("call_id").alias("document_id"), status.alias("status"), F.floor(F.col("duration_ms") % 5).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"), F.col("created_at").cast("timestamp").alias("run_after"), F.col("created_at").cast("timestamp").alias("locked_at"), (F.col("id") % 2 == 0).alias("retryable"))


JOBS = "jobs AS (SELECT id, call_id AS document_id, CASE WHEN span IN ('click', 'view') THEN 'queued' WHEN span = 'purchase' THEN 'running' ELSE 'done' END AS status, CAST(floor(duration_ms % 5) AS INT) AS attempts, 3 AS max_attempts, created_at AS run_after, created_at AS locked_at, id % 2 = 0 AS retryable FROM traces)"
T = f"TIMESTAMP '{ASOF_EVENT}'"


@query("lc1", with_tables("traces", "SELECT call_id AS document_id, max(id) AS id, arg_max(span, id) AS event FROM traces GROUP BY 1"))
def lc1(spark, d) -> DataFrame:
    return L.current_state(document_events(spark, d)).select("document_id", "id", "event")


@query("lc2", with_tables("docs", "SELECT id, CASE WHEN row_number() OVER (PARTITION BY sha256 ORDER BY id DESC) = 1 THEN 'ready' ELSE 'superseded' END AS new_status, lag(id) OVER (PARTITION BY sha256 ORDER BY id) AS supersedes_id FROM docs"))
def lc2(spark, d) -> DataFrame:
    """Every document promoted in order of its number; copies supersede each other."""
    return L.superseded(S.docs(spark, d).withColumn("promoted", F.col("id"))).select("id", "new_status", "supersedes_id")


@query("lc3", with_tables("docs lines", "SELECT d.id, count(*) AS chunks FROM docs d JOIN lines l ON l.document_id = d.id WHERE d.status = 'ready' GROUP BY 1"))
def lc3(spark, d) -> DataFrame:
    """Two snapshots published one after the other; readers get the second whole."""
    at = root(spark)
    docs, chunks = S.docs(spark, d).select("id", "status"), S.lines(spark, d).select("document_id", "line_no")
    L.publish({"documents": docs.filter("status = 'failed'"), "chunks": chunks}, at)
    L.publish({"documents": docs.filter("status = 'ready'"), "chunks": chunks}, at)
    return L.published(spark, at, "documents").join(L.published(spark, at, "chunks"), F.col("id") == F.col("document_id")).groupBy("id").agg(F.count("*").alias("chunks"))


@query("lc4", with_tables("docs lines traces", """
SELECT r.id, CASE WHEN d.id IS NULL THEN 'not_found' ELSE 'deleted' END AS outcome, CASE WHEN d.id IS NULL THEN 0 ELSE coalesce(n.n, 0) END AS chunks_deleted
FROM (SELECT DISTINCT call_id * 11 AS id FROM traces) r LEFT JOIN docs d ON d.id = r.id LEFT JOIN (SELECT document_id, count(*) AS n FROM lines GROUP BY 1) n ON n.document_id = r.id"""))
def lc4(spark, d) -> DataFrame:
    """Each user's events ask, again and again, for a document to be forgotten; some don't exist."""
    requests = S.traces(spark, d).select((F.col("call_id") * 11).alias("id"))
    return L.forget(requests, S.docs(spark, d), S.lines(spark, d))[2]


@query("lc4_remaining", with_tables("docs lines traces", "SELECT document_id, count(*) AS n FROM lines WHERE document_id NOT IN (SELECT call_id * 11 FROM traces) GROUP BY 1"))
def lc4_remaining(spark, d) -> DataFrame:
    requests = S.traces(spark, d).select((F.col("call_id") * 11).alias("id"))
    return L.forget(requests, S.docs(spark, d), S.lines(spark, d))[1].groupBy("document_id").agg(F.count("*").alias("n"))


def _snapshots(spark, d) -> tuple[DataFrame, DataFrame]:
    state = lambda mod: S.docs(spark, d).select("id", F.when(F.col("id") % mod == 0, "parsing").otherwise(F.col("status")).alias("status"), F.lit(0).alias("chunks"), F.lit(0).alias("embedded"), F.lit(None).cast("int").alias("pages"), F.when(F.col("id") % mod == 1, "boom").alias("error"))
    return state(7).filter("id % 10 != 3"), state(5).filter("id % 10 != 4")


SNAPSHOTS = "s AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'parsing' ELSE status END AS a, CASE WHEN id % 7 = 1 THEN 'boom' END AS ae, CASE WHEN id % 5 = 0 THEN 'parsing' ELSE status END AS b, CASE WHEN id % 5 = 1 THEN 'boom' END AS be FROM docs)"


@query("lc5", with_tables("docs", f", {SNAPSHOTS} SELECT id, CASE WHEN id % 10 = 4 THEN 'eliminado' ELSE 'documento' END AS change FROM s WHERE id % 10 = 4 OR id % 10 = 3 OR a IS DISTINCT FROM b OR ae IS DISTINCT FROM be"))
def lc5(spark, d) -> DataFrame:
    return L.snapshot_diff(*_snapshots(spark, d))


@query("lc6", with_tables("traces", f"SELECT id, 'documento' AS change FROM traces WHERE created_at >= {T} UNION ALL SELECT DISTINCT call_id, 'eliminado' FROM traces WHERE span = 'error' AND created_at >= {T}"))
def lc6(spark, d) -> DataFrame:
    t = S.traces(spark, d)
    docs = t.select("id", F.col("created_at").alias("updated_at"))
    events = t.select(F.col("call_id").alias("document_id"), F.when(F.col("span") == "error", "deleted").otherwise("x").alias("event"), "created_at")
    return L.since(docs, events, ASOF_EVENT)


@query("lc8", with_tables("traces docs", f"""
, {JOBS} SELECT d.id, CASE WHEN s.document_id IS NOT NULL AND d.id % 2 = 0 THEN 'failed' WHEN d.id % 2 = 0 THEN 'embedding' ELSE 'ready' END AS status, CASE WHEN s.document_id IS NOT NULL AND d.id % 2 = 0 THEN 'the job ran out of attempts' END AS error FROM docs d
LEFT JOIN (SELECT DISTINCT document_id FROM jobs WHERE status = 'running' AND attempts >= max_attempts AND locked_at < {T} - INTERVAL 5 MINUTE) s ON s.document_id = d.id"""))
def lc8(spark, d) -> DataFrame:
    docs = S.docs(spark, d).select("id", F.when(F.col("id") % 2 == 0, "embedding").otherwise("ready").alias("status"))
    return L.bury_stuck(jobs(spark, d), docs, now())[1]


@query("lc9", with_tables("traces docs", "SELECT t.call_id AS document_id, substr('failed with ' || t.span, 1, 500) AS error FROM traces t WHERE t.span = 'error' AND EXISTS (SELECT 1 FROM docs d WHERE d.id = t.call_id AND d.id % 3 > 0)"))
def lc9(spark, d) -> DataFrame:
    failures = S.traces(spark, d).filter("span = 'error'").select(F.col("call_id").alias("document_id"), F.concat(F.lit("failed with "), F.col("span")).alias("message"))
    return L.real_failures(failures, S.docs(spark, d).filter("id % 3 > 0"))


#: What the events say: views fail, clicks make ready, purchases count chunks and say nothing of the status; few documents go.
LC10_SQL = "WITH RECURSIVE" + with_tables("docs traces", """
, ev AS (SELECT call_id * 3 AS id, row_number() OVER (PARTITION BY call_id ORDER BY id) AS n, id % 997 = 0 AS gone, CASE span WHEN 'click' THEN 'ready' WHEN 'view' THEN 'failed' WHEN 'error' THEN 'failed' END AS status, CASE WHEN span = 'purchase' THEN CAST(floor(duration_ms) AS BIGINT) END AS chunks, CASE WHEN span = 'view' THEN 'event ' || id END AS error FROM traces),
f AS (SELECT id, 0 AS n, status, CAST(1 AS BIGINT) AS chunks, 'old' AS error, false AS gone FROM docs
  UNION ALL SELECT f.id, e.n, coalesce(e.status, f.status), coalesce(e.chunks, f.chunks), coalesce(e.error, CASE WHEN coalesce(e.status, f.status) = 'failed' THEN f.error END), f.gone OR e.gone FROM f JOIN ev e ON e.id = f.id AND e.n = f.n + 1)
SELECT id, status, chunks, error FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC) AS newest FROM f) WHERE newest = 1 AND NOT gone""")[4:]


def _listed(spark, d) -> DataFrame:
    return S.docs(spark, d).select("id", "status", F.lit(1).cast("long").alias("chunks"), F.lit("old").alias("error"))


def _feed(spark, d) -> DataFrame:
    span = F.col("span")
    told = S.traces(spark, d).select((F.col("call_id") * 3).alias("id"), F.col("id").alias("seq"), span.alias("span"), "duration_ms")
    status = F.when(span == "click", "ready").when(span.isin("view", "error"), "failed")
    return told.select("id", "seq", F.when(F.col("seq") % 997 == 0, "eliminado").otherwise("documento").alias("change"), status.alias("status"), F.when(span == "purchase", F.floor("duration_ms")).alias("chunks"), F.when(span == "view", F.concat(F.lit("event "), F.col("seq").cast("string"))).alias("error"))


@query("lc10", LC10_SQL)
def lc10(spark, d) -> DataFrame:
    """The listed documents after all events of their users, field by field."""
    return L.apply_feed(_listed(spark, d), _feed(spark, d))[0]


@query("lc10_stream", LC10_SQL)
def lc10_stream(spark, d) -> DataFrame:
    """The same list kept by a stream of the events in four batches; the third one is applied twice."""
    at, events = root(spark), root(spark)
    L.publish({"listed": _listed(spark, d), "unknown": _listed(spark, d).select("id").limit(0)}, at)
    cut = _feed(spark, d)
    quarters = [0, *cut.agg(F.percentile_approx("seq", [0.25, 0.5, 0.75]).alias("q")).first().q, None]
    for low, high in zip(quarters, quarters[1:], strict=False):
        part = cut.filter(F.col("seq") > low) if high is None else cut.filter((F.col("seq") > low) & (F.col("seq") <= high))
        (part if low else cut.filter(F.col("seq") <= high)).coalesce(1).write.mode("append").parquet(events)  # one file a batch, oldest first
    put = L.feed_sink(spark, at)

    def twice(batch: DataFrame, number: int) -> None:
        for _ in range(2 if number == 2 else 1):
            put(batch, number)

    files(spark, events).writeStream.foreachBatch(twice).option("checkpointLocation", root(spark)).trigger(availableNow=True).start().awaitTermination()
    return L.published(spark, at, "listed")


@query("jb1", with_tables("traces", f", {JOBS} SELECT id, document_id, status FROM jobs WHERE attempts < max_attempts AND (status = 'queued' AND run_after <= {T} OR status = 'running' AND locked_at < {T} - INTERVAL 5 MINUTE)"))
def jb1(spark, d) -> DataFrame:
    return L.claimable(jobs(spark, d), now()).select("id", "document_id", "status")


@query("jb2", with_tables("traces", f", {JOBS} SELECT id, CASE WHEN retryable AND attempts < max_attempts THEN 'queued' ELSE 'failed' END AS status, CAST(least(pow(2, attempts), 300) AS INT) AS wait_s, CASE WHEN retryable AND attempts < max_attempts THEN strftime({T} + to_seconds(CAST(least(pow(2, attempts), 300) AS INT)), '%Y-%m-%d %H:%M:%S') END AS run_after FROM jobs"))
def jb2(spark, d) -> DataFrame:
    return L.retries(jobs(spark, d), now()).withColumn("run_after", F.date_format("run_after", "yyyy-MM-dd HH:mm:ss"))

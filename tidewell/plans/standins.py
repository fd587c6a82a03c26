"""The driver's tables seen as the entities of the engine, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: As-of instants are literals.
ASOF_DAY, ASOF_EVENT = "1998-01-01", "2024-01-15 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SQL = {
    "patients": "SELECT c_custkey AS id, c_name AS full_name, 'CC ' || c_custkey AS documento_cc, c_mktsegment AS eps FROM customer",
    "surgeries": "SELECT o_orderkey AS id, o_custkey AS patient_id, o_orderpriority AS procedure_name, CAST(o_orderdate AS DATE) AS performed_at FROM orders",
    "medications": "SELECT l_orderkey AS surgery_id, l_linenumber AS line, 'med-' || l_partkey AS name, l_linestatus = 'O' AS active, CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(l_shipdate AS DATE) END AS ends_on FROM lineitem",
    "appointments": "SELECT o_orderkey AS id, o_custkey AS patient_id, o_orderdate AS scheduled_at, o_orderpriority AS location, CASE o_orderstatus WHEN 'O' THEN 'scheduled' ELSE 'done' END AS status FROM orders",
    "calls": "SELECT o_orderkey AS id, o_custkey AS patient_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'active' ELSE 'failed' END AS status, o_orderdate AS started_at, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate + to_seconds(CAST(floor(o_totalprice) AS BIGINT) % 3600) END AS ended_at, o_orderpriority LIKE '1-%' AS escalated FROM orders",
    "turns": "SELECT conv_id AS call_id, conv_id * 1000 + turn AS id, turn, CASE role WHEN 'user' THEN 'patient' WHEN 'assistant' THEN 'agent' ELSE 'system' END AS role, text AS content FROM conversations",
    "docs": "SELECT d.doc_id AS id, d.source AS filename, d.lang AS title, d.text, sha256(d.text) AS sha256, CAST(strlen(d.text) AS BIGINT) AS size_bytes, CASE l.quality WHEN 1 THEN 'ready' WHEN 0 THEN 'failed' ELSE 'uploaded' END AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "traces": "SELECT event_id AS id, user_id AS call_id, event_type AS span, value AS duration_ms, ts AS created_at FROM events",
    "lines": "SELECT doc_id AS document_id, lang, source, ordinal - 1 AS line_no, line AS content FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ordinal FROM documents)",
}


def with_tables(names: str, body: str) -> str:
    """body with the named stand-ins before it."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names.split()) + " " + body


def patients(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), F.concat(F.lit("CC "), F.col("c_custkey").cast("string")).alias("documento_cc"), F.col("c_mktsegment").alias("eps"))


def surgeries(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("patient_id"), F.col("o_orderpriority").alias("procedure_name"), F.to_date("o_orderdate").alias("performed_at"))


def medications(spark, d):
    ends = F.when(F.col("l_returnflag") != "R", F.to_date("l_shipdate"))
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("surgery_id"), F.col("l_linenumber").alias("line"), F.concat(F.lit("med-"), F.col("l_partkey").cast("string")).alias("name"), (F.col("l_linestatus") == "O").alias("active"), ends.alias("ends_on"))


def appointments(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("patient_id"), F.col("o_orderdate").alias("scheduled_at"), F.col("o_orderpriority").alias("location"), F.when(F.col("o_orderstatus") == "O", "scheduled").otherwise("done").alias("status"))


def calls(spark, d):
    s = F.col("o_orderstatus")
    ended = F.when(s != "O", F.timestamp_seconds(F.unix_timestamp("o_orderdate") + F.floor("o_totalprice") % 3600))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("patient_id"), F.when(s == "F", "completed").when(s == "O", "active").otherwise("failed").alias("status"), F.col("o_orderdate").cast("timestamp").alias("started_at"), ended.alias("ended_at"), F.col("o_orderpriority").startswith("1-").alias("escalated"))


def turns(spark, d):
    r = F.col("role")
    return read(spark, d, "conversations").select(F.col("conv_id").alias("call_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "turn", F.when(r == "user", "patient").when(r == "assistant", "agent").otherwise("system").alias("role"), F.col("text").alias("content"))


def docs(spark, d):
    q = F.col("quality")
    joined = read(spark, d, "documents").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.select(F.col("doc_id").alias("id"), F.col("source").alias("filename"), F.col("lang").alias("title"), "text", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"), F.when(q == 1, "ready").when(q == 0, "failed").otherwise("uploaded").alias("status"))


def traces(spark, d):
    return read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("call_id"), F.col("event_type").alias("span"), F.col("value").alias("duration_ms"), F.col("ts").alias("created_at"))


def lines(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "content")).withColumn("line_no", F.col("line_no").cast("long"))


VIEWS: dict[str, Callable] = {f.__name__: f for f in (patients, surgeries, medications, appointments, calls, turns, docs, traces, lines)}

"""Views, joins, roll-ups and windows over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import views as V
from tidewell.operators.quantiles import rolling_percentile
from tidewell.plans import standins as S
from tidewell.plans.registry import query
from tidewell.plans.standins import ASOF_DAY, with_tables

SCRIPT_COMMON_BEFORE = ("saludo", "dolor")
SCRIPT_COMMON_AFTER = ("animo", "cierre")
SCRIPT_BY_TAG = {"apendicectomia": ("fiebre", "herida"), "colecistectomia": ("dieta",), "hernia": ("esfuerzo", "inflamacion", "marcha")}
#: Alias found in a procedure's name, its protocol, in order of trust.
ALIASES = (("urgent", "apendicectomia"), ("high", "colecistectomia"), ("low", "hernia"), ("medium", "hernia"))
TAGS = ["apendicectomia", "colecistectomia", "hernia"]


def r6(c: str, name: str | None = None):
    return F.round(F.col(c).cast("double"), 6).alias(name or c)


@query("pr1", with_tables("docs", """
SELECT t.total, p.id, p.filename, p.status FROM (SELECT count(*) AS total FROM docs WHERE status = 'ready' AND (filename ILIKE '%c1%' OR coalesce(title, '') ILIKE '%c1%')) t
LEFT JOIN (SELECT id, filename, status FROM docs WHERE status = 'ready' AND (filename ILIKE '%c1%' OR coalesce(title, '') ILIKE '%c1%') ORDER BY id DESC LIMIT 20 OFFSET 10) p ON true"""))
def pr1(spark, d) -> DataFrame:
    """Second page of the ready documents whose name holds a text, newest first."""
    return V.document_listing(S.docs(spark, d), "ready", "c1", limit=20, offset=10)


@query("pr2", with_tables("lines", "SELECT document_id, line_no AS ordinal, substr(content, 1, 200) AS excerpt FROM lines WHERE line_no < 3"))
def pr2(spark, d) -> DataFrame:
    return V.preview(S.lines(spark, d).withColumnRenamed("line_no", "ordinal"))


@query("pr3", with_tables("calls, turns".replace(",", ""), """
SELECT c.status, CASE c.status WHEN 'active' THEN 'en_curso' WHEN 'completed' THEN 'completada' WHEN 'escalated' THEN 'completada' WHEN 'failed' THEN 'interrumpida' END AS status_label, count(*) AS n, 'call' AS kind FROM calls c GROUP BY 1
UNION ALL SELECT role, CASE role WHEN 'agent' THEN 'agente' WHEN 'patient' THEN 'paciente' ELSE 'sistema' END, count(*), 'turn' FROM turns GROUP BY 1"""))
def pr3(spark, d) -> DataFrame:
    a = S.calls(spark, d).groupBy("status").agg(F.count("*").alias("n")).select("status", V.relabel(F.col("status"), V.CALL_STATUS).alias("status_label"), "n", F.lit("call").alias("kind"))
    b = S.turns(spark, d).groupBy("role").agg(F.count("*").alias("n")).select(F.col("role").alias("status"), V.relabel(F.col("role"), V.ROLES).alias("status_label"), "n", F.lit("turn").alias("kind"))
    return a.unionByName(b)


def _answers(spark, d) -> DataFrame:
    """Survey answers: the event type is the key, the clicked value the answer."""
    return S.traces(spark, d).select("call_id", F.col("span").alias("key"), F.format_string("%.2f", "duration_ms").alias("value"), F.col("id").alias("turn"))


ANSWERS = "answers AS (SELECT call_id, span AS key, printf('%.2f', duration_ms) AS value, id AS turn FROM traces)"


@query("pr4", with_tables("traces", "SELECT call_id, span AS key, count(*) AS n, span IN ('click', 'view', 'purchase', 'otros_sintomas') AS accepted, CASE WHEN span NOT IN ('click', 'view', 'purchase', 'otros_sintomas') THEN 'click,otros_sintomas,purchase,view' END AS valid_keys FROM traces GROUP BY call_id, span"))
def pr4(spark, d) -> DataFrame:
    """Survey keys in the script's set pass; others come back with the valid set."""
    keys = spark.createDataFrame([(k,) for k in ("click", "view", "purchase", "otros_sintomas")], "key string")
    answers = S.traces(spark, d).select("call_id", F.col("span").alias("key"))
    good = answers.join(F.broadcast(keys), "key", "left_semi").withColumns({"accepted": F.lit(True), "valid_keys": F.lit(None).cast("string")})
    valid = keys.agg(F.array_join(F.sort_array(F.collect_set("key")), ",").alias("valid_keys"))
    bad = answers.join(F.broadcast(keys), "key", "left_anti").withColumn("accepted", F.lit(False)).crossJoin(F.broadcast(valid))  # one row
    return good.unionByName(bad).groupBy("call_id", "key", "accepted", "valid_keys").agg(F.count("*").alias("n"))


@query("pr5", with_tables("docs", """
SELECT id, CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN (size_bytes // 1024) || ' KB' ELSE (size_bytes // 1048576) || ' MB' END AS size_label,
CASE WHEN size_bytes % 4000 < 60 THEN (size_bytes % 4000) || ' s' ELSE (size_bytes % 4000) // 60 || ' min ' || (size_bytes % 4000) % 60 || ' s' END AS duration_label,
(size_bytes % 4000) // 60 || ':' || lpad(CAST((size_bytes % 4000) % 60 AS VARCHAR), 2, '0') AS clock_label,
CASE id % 40 WHEN 0 THEN 'hoy' WHEN 1 THEN 'ayer' ELSE 'hace ' || (id % 40) || ' días' END AS days_label, size_bytes || ' ms' AS ms_label, replace(printf('%.2f', (id % 100) / 100.0), '.', ',') AS score_label FROM docs"""))
def pr5(spark, d) -> DataFrame:
    n, s = F.col("size_bytes"), F.col("size_bytes") % 4000
    return S.docs(spark, d).select("id", V.human_bytes(n).alias("size_label"), V.human_duration(s).alias("duration_label"), V.clock(s).alias("clock_label"), V.days_since_label(F.col("id") % 40).alias("days_label"), F.concat(n.cast("string"), F.lit(" ms")).alias("ms_label"), F.replace(F.format_string("%.2f", (F.col("id") % 100) / 100.0), F.lit("."), F.lit(",")).alias("score_label"))


@query("pr6", with_tables("surgeries", f"SELECT id, day(performed_at) || ' de ' || ([{', '.join(repr(m) for m in V.MONTHS)}])[month(performed_at)] || ' de ' || year(performed_at) AS performed_text FROM surgeries"))
def pr6(spark, d) -> DataFrame:
    return S.surgeries(spark, d).select("id", V.date_in_words(F.col("performed_at")).alias("performed_text"))


@query("pr7", with_tables("docs", """
SELECT d.id, CASE d.status WHEN 'uploaded' THEN 1 WHEN 'ready' THEN 5 ELSE 0 END AS step, round(CASE WHEN n.chunks > 0 THEN least(1.0, n.embedded / n.chunks) ELSE 0.0 END, 6) AS fraction
FROM docs d JOIN (SELECT id, len(string_split(text, chr(10))) AS chunks, CASE WHEN id % 3 = 0 THEN len(string_split(text, chr(10))) ELSE len(string_split(text, chr(10))) // 2 END AS embedded FROM docs) n ON n.id = d.id"""))
def pr7(spark, d) -> DataFrame:
    docs = S.docs(spark, d).withColumn("chunks", F.size(F.split("text", "\n")))
    docs = docs.withColumn("embedded", F.when(F.col("id") % 3 == 0, F.col("chunks")).otherwise(F.floor(F.col("chunks") / 2)))
    step, fraction = V.ingest_progress(F.col("status"), F.col("embedded"), F.col("chunks"))
    return docs.select("id", step.cast("int").alias("step"), F.round(fraction, 6).alias("fraction"))


@query("jn1", with_tables("docs lines", "SELECT l.document_id, l.line_no AS ordinal, l.content, d.filename FROM lines l JOIN docs d ON d.id = l.document_id AND d.status = 'ready'"))
def jn1(spark, d) -> DataFrame:
    """Every line of the ready documents: all have vectors."""
    from tidewell.operators.retrieval import ready, retrievable
    from tidewell.plans.retrieval import chunks

    return retrievable(chunks(spark, d), ready(S.docs(spark, d))).select("document_id", "ordinal", "content", "filename")


@query("jn2", with_tables("patients surgeries", """
SELECT p.id, s.surgery_id, s.procedure_name, CAST(s.performed_at AS VARCHAR) AS performed_at FROM patients p LEFT JOIN
(SELECT patient_id, id AS surgery_id, procedure_name, performed_at, row_number() OVER (PARTITION BY patient_id ORDER BY performed_at DESC, id DESC) AS rn FROM surgeries) s ON s.patient_id = p.id AND s.rn = 1"""))
def jn2(spark, d) -> DataFrame:
    last = V.latest_surgery(S.surgeries(spark, d)).select("patient_id", F.col("id").alias("surgery_id"), "procedure_name", F.col("performed_at").cast("string").alias("performed_at"))
    return S.patients(spark, d).select("id").join(last, F.col("id") == F.col("patient_id"), "left").drop("patient_id")


LATEST = "latest AS (SELECT patient_id, procedure_name, performed_at FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY performed_at DESC, id DESC) AS rn FROM surgeries) WHERE rn = 1)"
LIVE = f"live AS (SELECT m.name, m.line, m.surgery_id, s.patient_id FROM medications m JOIN surgeries s ON s.id = m.surgery_id WHERE m.active AND (m.ends_on IS NULL OR m.ends_on >= DATE '{ASOF_DAY}'))"
AHEAD = f"ahead AS (SELECT patient_id, scheduled_at, location FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY scheduled_at, id) AS rn FROM appointments WHERE status = 'scheduled' AND scheduled_at >= TIMESTAMP '{ASOF_DAY} 00:00:00') WHERE rn = 1)"


def also(names: str, *ctes: str, body: str) -> str:
    return "WITH " + ", ".join([*(f"{n} AS ({S.SQL[n]})" for n in names.split()), *ctes]) + " " + body


@query("jn3", also("patients surgeries medications appointments calls", LATEST, LIVE, AHEAD, body=f"""
SELECT p.id, p.full_name, l.procedure_name, CAST(l.performed_at AS VARCHAR) AS performed_at, date_diff('day', l.performed_at, DATE '{ASOF_DAY}') AS days_since,
coalesce((SELECT count(*) FROM live WHERE live.patient_id = p.id), 0) AS medications, strftime((SELECT scheduled_at FROM ahead WHERE ahead.patient_id = p.id), '%Y-%m-%d') AS next_appointment,
strftime((SELECT max(started_at) FROM calls c WHERE c.patient_id = p.id), '%Y-%m-%d') AS last_call FROM patients p JOIN latest l ON l.patient_id = p.id"""))
def jn3(spark, d) -> DataFrame:
    """The call worklist."""
    w = V.worklist(S.patients(spark, d), S.surgeries(spark, d), S.medications(spark, d), S.appointments(spark, d), S.calls(spark, d), ASOF_DAY)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return w.orderBy(F.desc("performed_at"), "id").select("id", "full_name", "procedure_name", F.col("performed_at").cast("string").alias("performed_at"), F.col("days_since").cast("long").alias("days_since"), "medications", day("next_appointment"), day("last_call"))


@query("jn4", also("calls patients surgeries turns", LATEST, body=f"""
SELECT c.id, p.full_name, l.procedure_name, c.status, coalesce(t.turns, 0) AS turns, CAST(epoch(coalesce(c.ended_at, TIMESTAMP '{ASOF_DAY} 00:00:00')) - epoch(c.started_at) AS BIGINT) AS duration_s
FROM calls c LEFT JOIN patients p ON p.id = c.patient_id LEFT JOIN latest l ON l.patient_id = c.patient_id LEFT JOIN (SELECT call_id, count(*) AS turns FROM turns GROUP BY 1) t ON t.call_id = c.id"""))
def jn4(spark, d) -> DataFrame:
    return V.call_history(S.calls(spark, d), S.patients(spark, d), S.surgeries(spark, d), S.turns(spark, d), ASOF_DAY)


@query("jn5_whole", with_tables("turns", "SELECT call_id, string_agg(rn || ' ' || role || ': ' || coalesce(content, ''), ' | ' ORDER BY rn) AS turns FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY id) AS rn FROM turns) GROUP BY call_id"))
@query("jn5", with_tables("turns", "SELECT call_id, string_agg(rn || ' ' || role || ': ' || coalesce(content, ''), ' | ' ORDER BY rn) AS turns FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY id) AS rn FROM turns) GROUP BY call_id"))
def jn5(spark, d) -> DataFrame:
    """The call detail with the turns' whole contents."""
    text = F.transform("turns", lambda t: F.concat(t.ordinal.cast("string"), F.lit(" "), t.role, F.lit(": "), F.coalesce(t.content, F.lit(""))))
    return V.call_detail(S.turns(spark, d)).select("call_id", F.array_join(text, " | ").alias("turns"))


@query("jn6", also("medications surgeries", LIVE, body="SELECT patient_id, surgery_id, line, name FROM live"))
def jn6(spark, d) -> DataFrame:
    return V.active_medications(S.medications(spark, d), S.surgeries(spark, d), ASOF_DAY).orderBy("patient_id", "name").select("patient_id", "surgery_id", "line", "name")


@query("jn7", also("appointments", AHEAD, body="SELECT patient_id, strftime(scheduled_at, '%Y-%m-%d') AS scheduled_on, location FROM ahead"))
def jn7(spark, d) -> DataFrame:
    return V.next_appointment(S.appointments(spark, d), ASOF_DAY).select("patient_id", F.date_format("scheduled_at", "yyyy-MM-dd").alias("scheduled_on"), "location")


@query("jn8", with_tables("patients", "SELECT id, CAST(id AS VARCHAR) = CAST(id % 97 AS VARCHAR) AS strict_match, contains(CAST(id AS VARCHAR), CAST(id % 97 AS VARCHAR)) OR contains(CAST(id % 97 AS VARCHAR), CAST(id AS VARCHAR)) AS reference_match FROM patients"))
def jn8(spark, d) -> DataFrame:
    """Claimed ids that agree with the stored ones for some patients only."""
    claimed = F.concat(F.lit("C.C. "), (F.col("id") % 97).cast("string"), F.lit("."))
    return S.patients(spark, d).select("id", V.identity_check(claimed, F.col("documento_cc")).alias("strict_match"), V.identity_check(claimed, F.col("documento_cc"), strict=False).alias("reference_match"))


@query("jn10", with_tables("docs", """
, batch AS (SELECT id AS upload_id, sha256 FROM docs), known AS (SELECT sha256, max(CASE WHEN status = 'uploaded' THEN 1 ELSE 0 END) AS busy, max(CASE WHEN status = 'ready' THEN id END) AS ready_id FROM docs WHERE id % 2 = 0 GROUP BY sha256)
SELECT upload_id, decision, CASE WHEN decision = 'new_version' THEN ready_id END AS supersedes_id FROM (SELECT b.upload_id, k.ready_id, CASE WHEN rn > 1 OR coalesce(k.busy, 0) = 1 THEN 'conflict' WHEN k.ready_id IS NOT NULL THEN 'new_version' ELSE 'new' END AS decision
FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY upload_id) AS rn FROM batch) b LEFT JOIN known k ON k.sha256 = b.sha256)"""))
def jn10(spark, d) -> DataFrame:
    """Every document uploaded again against a catalog of the documents with even ids."""
    docs = S.docs(spark, d)
    return V.upload_decisions(docs.select(F.col("id").alias("upload_id"), "sha256"), docs.filter("id % 2 = 0"))


def _tagged_calls(spark, d) -> DataFrame:
    tag = F.when(F.col("id") % 5 == 0, "hernia").otherwise(F.concat(F.lit("tag-"), (F.col("id") % 3).cast("string")))
    return S.surgeries(spark, d).select("id", "procedure_name", tag.alias("tag"))


def _aliases(spark) -> DataFrame:
    return spark.createDataFrame([(a, t, i) for i, (a, t) in enumerate(ALIASES)], "alias string, alias_tag string, priority int")


PROTOCOLS = """protocols AS (SELECT id, CASE WHEN tag = 'hernia' THEN tag WHEN lower(procedure_name) LIKE '%urgent%' THEN 'apendicectomia' WHEN lower(procedure_name) LIKE '%high%' THEN 'colecistectomia' WHEN lower(procedure_name) LIKE '%low%' THEN 'hernia' WHEN lower(procedure_name) LIKE '%medium%' THEN 'hernia' ELSE tag END AS protocol
FROM (SELECT id, procedure_name, CASE WHEN id % 5 = 0 THEN 'hernia' ELSE 'tag-' || id % 3 END AS tag FROM surgeries))"""


@query("jn11", also("surgeries", PROTOCOLS, body="SELECT id, protocol FROM protocols"))
def jn11(spark, d) -> DataFrame:
    return V.resolve_protocol(_tagged_calls(spark, d), _aliases(spark), TAGS)


@query("jn12", also("surgeries", PROTOCOLS, body="""
, script AS (SELECT * FROM (VALUES ('apendicectomia', 2, 'fiebre'), ('apendicectomia', 3, 'herida'), ('colecistectomia', 2, 'dieta'), ('hernia', 2, 'esfuerzo'), ('hernia', 3, 'inflamacion'), ('hernia', 4, 'marcha')) v(tag, pos, key))
SELECT id, key, row_number() OVER (PARTITION BY id ORDER BY pos) AS ordinal FROM (
SELECT p.id, c.pos, c.key FROM protocols p CROSS JOIN (VALUES (0, 'saludo'), (1, 'dolor'), (98, 'animo'), (99, 'cierre')) c(pos, key) UNION ALL SELECT p.id, s.pos, s.key FROM protocols p JOIN script s ON s.tag = p.protocol)""".lstrip("\n")))
def jn12(spark, d) -> DataFrame:
    """Questions of each call: common ones before and after those of its protocol."""
    rows = [(tag, i, k) for tag in [*SCRIPT_BY_TAG, None] for i, k in enumerate((*SCRIPT_COMMON_BEFORE, *SCRIPT_BY_TAG.get(tag, ()), *SCRIPT_COMMON_AFTER), 1)]
    script = spark.createDataFrame(rows, "script string, ordinal int, key string")
    calls = jn11(spark, d).withColumn("script", F.when(F.col("protocol").isin(*SCRIPT_BY_TAG), F.col("protocol")))
    return calls.join(F.broadcast(script), calls.script.eqNullSafe(script.script)).select("id", "key", F.col("ordinal").cast("long").alias("ordinal"))


@query("ag1", with_tables("lines", "SELECT l.document_id, count(*) AS chunks_count, count(e.vec_id) AS embedded_count FROM lines l LEFT JOIN embeddings e ON e.vec_id = l.document_id AND l.line_no = 0 GROUP BY 1"))
def ag1(spark, d) -> DataFrame:
    vectors = S.read(spark, d, "embeddings").select(F.col("vec_id").alias("document_id"), F.lit(0).cast("long").alias("line_no"), "embedding")
    return S.lines(spark, d).join(vectors, ["document_id", "line_no"], "left").groupBy("document_id").agg(F.count("*").alias("chunks_count"), F.count("embedding").alias("embedded_count"))


@query("ag2", also("traces", ANSWERS, body="SELECT call_id, string_agg(key || '=' || value, ',' ORDER BY key) AS survey FROM (SELECT call_id, key, arg_max(value, turn) AS value FROM answers GROUP BY 1, 2) GROUP BY 1"))
def ag2(spark, d) -> DataFrame:
    maps = V.as_maps(V.survey_answers(_answers(spark, d)))
    return maps.select("call_id", F.array_join(F.transform(F.map_entries("survey"), lambda e: F.concat(e.key, F.lit("="), e.value)), ",").alias("survey"))


@query("ag3", with_tables("traces", "SELECT call_id, arg_max(span, id) AS reason, arg_max(CASE WHEN duration_ms > 100 THEN 'urgente' WHEN duration_ms > 20 THEN 'rutina' ELSE 'prioritaria' END, id) AS urgency FROM traces WHERE span IN ('error', 'signup') GROUP BY 1"))
def ag3(spark, d) -> DataFrame:
    """The last escalation of a call; an unknown urgency counts as prioritaria."""
    urgency = F.when(F.col("duration_ms") > 100, "urgente").when(F.col("duration_ms") > 20, "rutina").otherwise("desconocida")
    rows = S.traces(spark, d).filter(F.col("span").isin("error", "signup")).withColumn("urgency", urgency)
    last = rows.groupBy("call_id").agg(F.max_by(F.struct("span", "urgency"), "id").alias("e"))
    return last.select("call_id", F.col("e.span").alias("reason"), F.when(F.col("e.urgency").isin("urgente", "prioritaria", "rutina"), F.col("e.urgency")).otherwise("prioritaria").alias("urgency"))


CLOSES = "closes AS (SELECT call_id, id, CASE span WHEN 'click' THEN 'completada' WHEN 'view' THEN 'escalada' ELSE 'otra' END AS reason, duration_ms > 250 AS escalated FROM traces)"


@query("ag4", also("traces", CLOSES, body="SELECT call_id, CASE WHEN bool_or(escalated) OR arg_min(reason, id) = 'escalada' THEN 'escalated' WHEN arg_min(reason, id) = 'completada' THEN 'completed' ELSE 'failed' END AS status FROM closes GROUP BY 1"))
def ag4(spark, d) -> DataFrame:
    reason = F.when(F.col("span") == "click", "completada").when(F.col("span") == "view", "escalada").otherwise("otra")
    return V.close_status(S.traces(spark, d).select("call_id", "id", reason.alias("reason"), (F.col("duration_ms") > 250).alias("escalated")))


@query("ag5", with_tables("traces", "SELECT span, round(quantile_cont(duration_ms, 0.5), 6) AS p50, round(quantile_cont(duration_ms, 0.95), 6) AS p95, count(*) AS n FROM traces GROUP BY 1"))
def ag5(spark, d) -> DataFrame:
    return V.span_percentiles(S.traces(spark, d)).select("span", r6("p50"), r6("p95"), "n")


@query("ag6", with_tables("traces", """
SELECT round(s.a, 4) AS sum_p50, round(s.b, 4) AS sum_p95, round(t.a, 4) AS true_p50, round(t.b, 4) AS true_p95 FROM (SELECT sum(p50) AS a, sum(p95) AS b FROM (SELECT quantile_cont(duration_ms, 0.5) AS p50, quantile_cont(duration_ms, 0.95) AS p95 FROM traces GROUP BY span)) s
CROSS JOIN (SELECT quantile_cont(v, 0.5) AS a, quantile_cont(v, 0.95) AS b FROM (SELECT sum(duration_ms) AS v FROM traces GROUP BY call_id)) t"""))
def ag6(spark, d) -> DataFrame:
    e = V.end_to_end(S.traces(spark, d))
    return e.select(*(F.round(c, 4).alias(c) for c in e.columns))


@query("ag7", with_tables("traces", "SELECT call_id, span, round(median(duration_ms), 6) AS median_ms FROM traces WHERE duration_ms IS NOT NULL AND NOT isnan(duration_ms) GROUP BY 1, 2"))
def ag7(spark, d) -> DataFrame:
    return V.stage_medians(S.traces(spark, d)).select("call_id", "span", r6("median_ms"))


@query("ag8", with_tables("traces", """
, last AS (SELECT call_id, span, arg_max(duration_ms, id) AS last_ms FROM traces GROUP BY 1, 2)
SELECT call_id, span, round(last_ms, 6) AS last_ms, round(sum(last_ms) OVER (PARTITION BY call_id), 6) AS total_ms, round(least(1.0, last_ms / greatest(400.0, max(last_ms) OVER (PARTITION BY call_id))), 6) AS share FROM last"""))
def ag8(spark, d) -> DataFrame:
    return V.last_stage_values(S.traces(spark, d)).select("call_id", "span", r6("last_ms"), r6("total_ms"), r6("share"))


@query("ag9", with_tables("turns", """
SELECT call_id, sum(CASE WHEN role = 'patient' THEN length(content) // 4 ELSE 0 END) AS tokens_in, sum(CASE WHEN role = 'agent' THEN length(content) // 4 ELSE 0 END) AS tokens_out,
round(sum(CASE WHEN role = 'patient' THEN (length(content) // 4) * 0.075 WHEN role = 'agent' THEN (length(content) // 4) * 0.30 ELSE 0 END) / 1000000, 9) AS cost_usd FROM turns GROUP BY 1"""))
def ag9(spark, d) -> DataFrame:
    """Tokens (four characters each) and cost by the price table of each side."""
    prices = spark.createDataFrame([("patient", 0.075), ("agent", 0.30), ("system", 0.0)], "role string, usd_per_million double")
    t = S.turns(spark, d).withColumn("tokens", F.floor(F.length("content") / 4)).join(F.broadcast(prices), "role")
    of = lambda r: F.sum(F.when(F.col("role") == r, F.col("tokens")).otherwise(0))
    return t.groupBy("call_id").agg(of("patient").alias("tokens_in"), of("agent").alias("tokens_out"), F.round(F.sum(F.col("tokens") * F.col("usd_per_million")) / 1000000, 9).alias("cost_usd"))


@query("ag10", with_tables("turns", "SELECT CASE WHEN call_id % 2 = 0 THEN 'local' ELSE 'cloud' END AS mode, count(*) AS n, sum(length(content)) AS characters, CAST(round(avg(turn * 10)) AS BIGINT) AS mean_ms, round(sum(length(content) / 15.0), 1) AS audio_s FROM turns WHERE role = 'agent' GROUP BY 1"))
def ag10(spark, d) -> DataFrame:
    t = S.turns(spark, d).filter("role = 'agent'").withColumn("mode", F.when(F.col("call_id") % 2 == 0, "local").otherwise("cloud"))
    return t.groupBy("mode").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("characters"), F.round(F.avg(F.col("turn") * 10)).cast("long").alias("mean_ms"), F.round(F.sum(F.length("content") / 15.0), 1).alias("audio_s"))


@query("ag11", with_tables("traces", "SELECT call_id AS key, CASE arg_max(span, id) WHEN 'click' THEN 'cloud' WHEN 'view' THEN 'local' ELSE 'local' END AS value FROM traces GROUP BY 1"))
def ag11(spark, d) -> DataFrame:
    """Latest value of each setting; values that aren't a mode fall back to local."""
    written = V.relabel(F.col("span"), {"click": "cloud", "view": "local"}, default="?")
    last = S.traces(spark, d).groupBy(F.col("call_id").alias("key")).agg(F.max_by(written, "id").alias("v"))
    return last.select("key", F.when(F.col("v").isin("cloud", "local"), F.col("v")).otherwise("local").alias("value"))


@query("ag12", with_tables("lines", """
SELECT document_id, arg_max(size, n * 1000 - size) AS body_size FROM (SELECT document_id, round((8 + length(content) % 13 / 4.0) * 2) / 2 AS size, sum(length(trim(content))) AS n FROM lines GROUP BY 1, 2) GROUP BY 1"""))
def ag12(spark, d) -> DataFrame:
    """Font size that most characters of a document have, on a half-point grid; the smaller one on a tie."""
    from tidewell.operators.layout import body_size

    spans = S.lines(spark, d).select(F.col("document_id"), (8 + (F.length("content") % 13) / 4.0).alias("font_size"), F.col("content").alias("text"))
    return body_size(spans)


@query("ag13", with_tables("turns", "SELECT call_id, role, string_agg(k, ',' ORDER BY first_id) AS citations FROM (SELECT call_id, role, substr(content, 1, 2) AS k, min(id) AS first_id FROM turns GROUP BY 1, 2, 3) GROUP BY 1, 2"))
def ag13(spark, d) -> DataFrame:
    """Distinct citations in order of their first appearance."""
    seen = S.turns(spark, d).groupBy("call_id", "role", F.substring("content", 1, 2).alias("k")).agg(F.min("id").alias("first_id"))
    listed = seen.groupBy("call_id", "role").agg(F.sort_array(F.collect_list(F.struct("first_id", "k"))).alias("c"))
    return listed.select("call_id", "role", F.array_join(F.transform("c", lambda x: x.k), ",").alias("citations"))


@query("ag14", with_tables("docs lines", """
SELECT count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status NOT IN ('ready', 'failed', 'superseded')) AS in_progress, count(*) FILTER (status = 'failed') AS failed,
CAST(sum(CASE WHEN status = 'ready' THEN coalesce(n, 0) ELSE 0 END) AS BIGINT) AS ready_chunks, count(*) AS total FROM docs LEFT JOIN (SELECT document_id, count(*) AS n FROM lines GROUP BY 1) l ON l.document_id = docs.id"""))
def ag14(spark, d) -> DataFrame:
    return V.corpus_summary(S.docs(spark, d), S.lines(spark, d))


@query("ag15", with_tables("turns", "SELECT call_id, count(*) FILTER (role = 'patient') AS patient_turns, count(*) FILTER (role = 'agent') AS agent_turns, count(*) FILTER (role = 'system') AS system_turns, CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS citations FROM turns GROUP BY 1"))
def ag15(spark, d) -> DataFrame:
    of = lambda r: F.count_if(F.col("role") == r).alias(f"{r}_turns")
    return S.turns(spark, d).groupBy("call_id").agg(of("patient"), of("agent"), of("system"), F.sum(F.size(F.split("content", "\n"))).alias("citations"))


@query("wn1", with_tables("traces", "SELECT call_id, id, round(duration_ms, 6) AS duration_ms, rn FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY duration_ms DESC, id) AS rn FROM traces) WHERE rn <= 16"))
def wn1(spark, d) -> DataFrame:
    from tidewell.operators.retrieval import top_k

    return top_k(S.traces(spark, d), ["call_id"], [F.desc("duration_ms"), F.col("id")], 16, "rn").select("call_id", "id", r6("duration_ms"), F.col("rn").cast("long").alias("rn"))


@query("wn2", with_tables("lines", """
, body AS (SELECT document_id, arg_max(size, n * 1000 - size) AS body_size FROM (SELECT document_id, round((8 + length(content) % 13 / 4.0) * 2) / 2 AS size, sum(length(trim(content))) AS n FROM lines GROUP BY 1, 2) GROUP BY 1)
SELECT document_id, size, level FROM (SELECT s.document_id, s.size, dense_rank() OVER (PARTITION BY s.document_id ORDER BY s.size DESC) AS level FROM (SELECT DISTINCT document_id, round((8 + length(content) % 13 / 4.0) * 2) / 2 AS size FROM lines) s JOIN body b ON b.document_id = s.document_id AND s.size >= b.body_size + 0.6) WHERE level <= 6"""))
def wn2(spark, d) -> DataFrame:
    from tidewell.operators.layout import heading_levels

    return heading_levels(S.lines(spark, d).select("document_id", (8 + (F.length("content") % 13) / 4.0).alias("font_size"), F.col("content").alias("text")))


#: Every call's frames, and all frames of the log as one stream, which fills the frame of 4,096.
WN3_SQL = with_tables("traces", "SELECT id, round(quantile_cont(duration_ms, 0.95) OVER (PARTITION BY call_id ORDER BY id ROWS BETWEEN 4095 PRECEDING AND CURRENT ROW), 6) AS p95_call, round(quantile_cont(duration_ms, 0.95) OVER (ORDER BY id ROWS BETWEEN 4095 PRECEDING AND CURRENT ROW), 6) AS p95_log FROM traces")


@query("wn3", WN3_SQL)
def wn3(spark, d) -> DataFrame:
    """Rolling 95th percentile over a stream's last 4,096 frames."""
    frames = S.traces(spark, d).select("id", "call_id", F.lit(0).alias("log"), "duration_ms")
    of = lambda by, name: rolling_percentile(frames, [by], "id", "duration_ms", 0.95, 4_096).select("id", F.round("p", 6).alias(name))
    return of("call_id", "p95_call").join(of("log", "p95_log"), "id")


@query("wn4", """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS t, CAST(round(value * 100) AS BIGINT) * 10000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
clock AS (SELECT user_id, event_id, rn, t + ms AS until FROM e WHERE rn = 1 UNION ALL SELECT e.user_id, e.event_id, e.rn, greatest(e.t, c.until) + e.ms FROM clock c JOIN e ON e.user_id = c.user_id AND e.rn = c.rn + 1)
SELECT event_id, until FROM clock""")
def wn4(spark, d) -> DataFrame:
    """Playback clock of each stream, against a recursive loop."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000
    sent = S.read(spark, d, "events").select("user_id", "event_id", t.alias("t"), (F.round(F.col("value") * 100).cast("long") * 10000).alias("ms"))
    return V.playback_clock(sent, "user_id", "t", "ms", "event_id").select("event_id", "until")


@query("wn5", with_tables("calls", "SELECT id, status FROM calls ORDER BY started_at DESC, id DESC LIMIT 50"))
def wn5(spark, d) -> DataFrame:
    return S.calls(spark, d).orderBy(F.desc("started_at"), F.desc("id")).limit(50).select("id", "status")

"""Sources and sinks over the driver's tables: pages are uploads, customers and orders patient records, benchmark passages questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.plans import standins as S
from tidewell.plans.registry import query
from tidewell.sources import files as L
from tidewell.streaming.run import folder

EXT = r"lower(regexp_extract(name, '(\.[A-Za-z0-9]+)$', 1))"
UPLOADS = "uploads AS (SELECT page_id AS id, regexp_extract(url, '([^/]*)$', 1) AS name, CASE page_id % 4 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'TEXT/PLAIN' WHEN 2 THEN 'image/png' END AS mime, CASE WHEN page_id % 11 = 0 THEN 0 WHEN page_id % 13 = 0 THEN 30000000 ELSE strlen(html) END AS size_bytes FROM pages)"
FORMAT = f"coalesce(CASE {EXT} WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'docx' WHEN '.md' THEN 'markdown' WHEN '.markdown' THEN 'markdown' WHEN '.txt' THEN 'text' WHEN '.html' THEN 'html' END, CASE lower(trim(string_split(mime, ';')[1])) WHEN 'text/html' THEN 'html' WHEN 'text/plain' THEN 'text' END)"


def uploads(spark, d) -> DataFrame:
    i = F.col("page_id")
    mime = F.when(i % 4 == 0, "text/html; charset=utf-8").when(i % 4 == 1, "TEXT/PLAIN").when(i % 4 == 2, "image/png")
    size = F.when(i % 11 == 0, 0).when(i % 13 == 0, 30_000_000).otherwise(F.octet_length("html"))
    return S.read(spark, d, "pages").select(i.alias("id"), F.regexp_extract("url", "([^/]*)$", 1).alias("name"), mime.alias("mime"), size.alias("size_bytes"))


@query("sc1", S.with_tables("docs", "SELECT filename || '.txt' AS name, count(*) AS files, CAST(sum(size_bytes + 1) AS BIGINT) AS size_bytes FROM docs GROUP BY 1"))
def sc1(spark, d) -> DataFrame:
    """The documents written as text files, one folder a source, and enumerated again."""
    at = folder(spark)
    L.write_texts(S.docs(spark, d).select(F.col("filename").alias("name"), "text"), at)
    texts = L.read_texts(spark, at).select(F.concat("name", F.lit(".txt")).alias("name"), "text")
    return texts.groupBy("name").agg(F.count("*").alias("files"), F.sum(F.octet_length("text") + 1).alias("size_bytes"))


@query("sc2", f"WITH {UPLOADS} SELECT id, {FORMAT} AS format FROM uploads")
def sc2(spark, d) -> DataFrame:
    return uploads(spark, d).select("id", L.resolved_format(F.col("name"), F.col("mime")).alias("format"))


@query("sc3", f"WITH {UPLOADS}, f AS (SELECT *, {FORMAT} AS format FROM uploads) SELECT id, CASE WHEN format IS NULL THEN 'unsupported' WHEN size_bytes = 0 THEN 'empty' WHEN size_bytes > 26214400 THEN 'too large' END AS reason, CASE WHEN format IS NULL OR size_bytes = 0 OR size_bytes > 26214400 THEN 'rejected' ELSE 'accepted' END AS status FROM f")
def sc3(spark, d) -> DataFrame:
    return L.triaged(uploads(spark, d)).select("id", "reason", "status")


@query("sc4", "SELECT page_id AS id, sha256(html) AS sha256 FROM pages")
def sc4(spark, d) -> DataFrame:
    pages = S.read(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").cast("binary").alias("content"))
    return L.fingerprinted(pages).select("id", "sha256")


RECORDS = "clinical AS (SELECT o_custkey AS paciente_id, CASE o_orderkey % 4 WHEN 0 THEN 'Apendicectomia' WHEN 1 THEN 'Herniorrafia' ELSE 'Otra' END AS procedimiento, CASE o_orderkey % 3 WHEN 0 THEN 'Gallstones' ELSE 'x' END AS modulo FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1), both_ AS (SELECT c.c_custkey AS id, k.*, coalesce(CASE lower(procedimiento) WHEN 'apendicectomia' THEN 'apendicectomia' WHEN 'herniorrafia' THEN 'hernia' END, CASE lower(modulo) WHEN 'gallstones' THEN 'colecistectomia' END, 'apendicectomia') AS tag FROM customer c JOIN clinical k ON k.paciente_id = c.c_custkey)"


@query("sc5", f"WITH {RECORDS} SELECT id, tag AS protocol_tag, 2 AS medications, 1 AS appointments FROM both_")
def sc5(spark, d) -> DataFrame:
    """Patient records from customers and each one's first order."""
    from tidewell.operators.views import latest

    orders = latest(S.read(spark, d, "orders"), "o_custkey", F.col("o_orderkey"))
    k = F.col("o_orderkey")
    clinical = orders.select(F.col("o_custkey").alias("paciente_id"), F.when(k % 4 == 0, "Apendicectomia").when(k % 4 == 1, "Herniorrafia").otherwise("Otra").alias("procedimiento"), F.when(k % 3 == 0, "Gallstones").otherwise("x").alias("modulo"))
    profiles = S.read(spark, d, "customer").select(F.col("c_custkey").alias("paciente_id"), F.col("c_name").alias("nombre"), F.col("c_custkey").cast("string").alias("documento"))
    t = L.patient_records(profiles, clinical)
    count = lambda name: t[name].groupBy(F.col("patient_id").alias("id")).agg(F.count("*").cast("int").alias(name))
    tags = t["surgeries"].select(F.col("patient_id").alias("id"), "protocol_tag")
    return t["patients"].select("id").join(tags, "id").join(count("medications"), "id").join(count("appointments"), "id")


@query("sc6", "SELECT CAST(item_id AS VARCHAR) AS id, length(text) AS n, 'src' || (item_id % 20) AS documento_esperado FROM benchmark")
def sc6(spark, d) -> DataFrame:
    """The benchmark written as one JSON array for each file, and read as a question set."""
    at = folder(spark)
    items = S.read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("pregunta"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("documento_esperado"))
    # a question set is a small file that someone wrote by hand: here one file for each expected document
    arrays = items.groupBy("documento_esperado").agg(F.to_json(F.collect_list(F.struct("id", "pregunta", "documento_esperado"))).alias("value"))
    arrays.repartition(F.col("documento_esperado")).select("documento_esperado", "value").write.partitionBy("documento_esperado").text(at)
    found = L.golden_set(spark, f"{at}/*")
    return found.select("id", F.length("pregunta").cast("long").alias("n"), "documento_esperado")


BODY = """CASE id % 5 WHEN 0 THEN '{"id": "' || id || '", "filename": "a.pdf", "heading": "H", "page": 3, "turnos": 4}' WHEN 1 THEN '{"id": "' || id || '", "documento": "b.pdf", "pagina": "x", "turnos": [1, 2]}' WHEN 2 THEN '{"id": "' || id || '", "source": "c.pdf", "seccion": "S"}' WHEN 3 THEN '{"id": ""}' ELSE 'not json' END"""


@query("sc7", """SELECT CAST(event_id AS VARCHAR) AS id, CASE event_id % 5 WHEN 0 THEN 'a.pdf' WHEN 1 THEN 'b.pdf' ELSE 'c.pdf' END AS filename, CASE event_id % 5 WHEN 0 THEN 'H' WHEN 2 THEN 'S' END AS heading, CASE event_id % 5 WHEN 0 THEN 3 END AS page, CASE event_id % 5 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 0 END AS turnos FROM events WHERE event_id % 5 < 3""")
def sc7(spark, d) -> DataFrame:
    """Citations from JSON of several shapes; rows without an id are dropped."""
    e = S.read(spark, d, "events").select(F.col("event_id").alias("id")).select(F.expr(BODY.replace("' || id || '", "' || cast(id as string) || '")).alias("body"))
    c = e.select(L.lenient_citation(F.col("body")).alias("c"), L.lenient_turns(F.col("body")).alias("turnos"))
    return c.filter("c.id is not null and c.id != ''").select("c.*", "turnos")


@query("sc8", "SELECT event_id AS id, user_id AS page, CAST(floor(value) AS BIGINT) AS llm, event_type AS animo, CAST(1 + event_id % 2 AS BIGINT) AS answers FROM events")
def sc8(spark, d) -> DataFrame:
    """Citations, latencies and survey answers to JSON and back."""
    e = S.read(spark, d, "events")
    rows = e.select(F.col("event_id").alias("id"), F.array(F.struct(F.lit("a.pdf").alias("filename"), F.lit("h").alias("heading"), F.col("user_id").cast("int").alias("page"))).alias("citations"), F.create_map(F.lit("llm"), F.floor("value")).alias("latencies"), F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("animo"), F.col("event_type"))).otherwise(F.create_map(F.lit("animo"), F.col("event_type"), F.lit("dolor"), F.lit("\"7\"\n"))).alias("survey"))
    back = L.decode_columns(L.encode_columns(rows))
    return back.select("id", F.get("citations", 0)["page"].cast("long").alias("page"), back.latencies["llm"].alias("llm"), back.survey["animo"].alias("animo"), F.size("survey").cast("long").alias("answers"))


@query("sc9", "SELECT event_type AS metric, count(*) AS n FROM events GROUP BY 1")
def sc9(spark, d) -> DataFrame:
    """Metrics and detail written as JSON and read back."""
    at = folder(spark)
    e = S.read(spark, d, "events")
    L.write_metrics(e.groupBy(F.col("event_type").alias("metric")).agg(F.count("*").alias("n")), e.select("event_id", "value"), at)
    return spark.read.schema("metric string, n long").json(f"{at}/metrics")

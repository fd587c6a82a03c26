"""Sources and sinks: files of the corpus, patient records, question sets, lenient JSON, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.config import SETTINGS

FORMATS = {".pdf": "pdf", ".docx": "docx", ".md": "markdown", ".markdown": "markdown", ".txt": "text", ".html": "html"}
MIME_FORMATS = {"application/pdf": "pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "text/markdown": "markdown", "text/plain": "text", "text/html": "html"}
CITATIONS = T.ArrayType(T.StructType([T.StructField("filename", T.StringType()), T.StructField("heading", T.StringType()), T.StructField("page", T.IntegerType())]))
LATENCIES, SURVEY = T.MapType(T.StringType(), T.LongType()), T.MapType(T.StringType(), T.StringType())
PROCEDURE_TAGS = {"apendicectomia": "apendicectomia", "colecistectomia": "colecistectomia", "herniorrafia": "hernia"}
MODULE_TAGS = {"appendicitis": "apendicectomia", "gallstones": "colecistectomia"}
DEFAULT_TAG = "apendicectomia"


def corpus_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, name, size_bytes, content of the files below a folder; name and size alone don't read contents."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size_bytes"), "content")


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and whole text of each file."""
    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


#: What ends each text in a file of texts; what stands before a letter for it, for itself, and for no text at all; texts of a file.
END, ESCAPE, FILE_TEXTS = "\x01", "\x02", 1_000


def write_texts(texts: DataFrame, folder: str) -> None:
    """Texts (name, text) as text files of at most FILE_TEXTS each, in a folder for each name; any text, none, and any name come back."""
    framed = F.replace(F.replace("text", F.lit(ESCAPE), F.lit(f"{ESCAPE}e")), F.lit(END), F.lit(f"{ESCAPE}n"))
    # no name and an empty one would share a folder
    named = texts.select(F.coalesce(F.concat(F.lit("s"), "name"), F.lit("n")).alias("name"), F.coalesce(framed, F.lit(f"{ESCAPE}0")).alias("text"))
    named.write.partitionBy("name").option("lineSep", END).option("maxRecordsPerFile", FILE_TEXTS).text(folder)


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """name, text of what write_texts() wrote, empty texts and nulls among them."""
    escaped = F.regexp_extract("path", "/name=([^/]*)/[^/]*$", 1)
    known = F.url_decode(F.replace(escaped, F.lit("+"), F.lit("%2B")))
    parts = F.split(F.col("content").cast("string"), END)
    whole = corpus_files(spark, folder, "*.txt").select(known.alias("known"), F.explode(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("t"))
    text = F.replace(F.replace("t", F.lit(f"{ESCAPE}n"), F.lit(END)), F.lit(f"{ESCAPE}e"), F.lit(ESCAPE))
    return whole.select(F.when(F.col("known") != "n", F.expr("substring(known, 2)")).alias("name"), F.when(F.col("t") != f"{ESCAPE}0", text).alias("text"))


def _lookup(key: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def resolved_format(name: Column, mime: Column) -> Column:
    """Format by extension, else by MIME type without its parameters; null where neither is known."""
    extension = F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1))
    return F.coalesce(_lookup(extension, FORMATS), _lookup(F.lower(F.trim(F.split(mime, ";")[0])), MIME_FORMATS))


def triaged(files: DataFrame) -> DataFrame:
    """files (name, mime, size_bytes) with format, status and reason; a rejected file rejects no other."""
    f = files.withColumn("format", resolved_format(F.col("name"), F.col("mime")))
    reason = F.when(F.col("format").isNull(), "unsupported").when(F.col("size_bytes") == 0, "empty").when(F.col("size_bytes") > SETTINGS.max_upload_bytes, "too large")
    return f.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected"))


def fingerprinted(files: DataFrame) -> DataFrame:
    return files.withColumn("sha256", F.sha2("content", 256))


def patient_records(profiles: DataFrame, clinical: DataFrame) -> dict[str, DataFrame]:
    """Tables from profiles joined to clinical rows by patient: one patient, one surgery, two medications, one appointment each."""
    both = profiles.join(clinical, "paciente_id")
    tag = F.coalesce(_lookup(F.lower("procedimiento"), PROCEDURE_TAGS), _lookup(F.lower("modulo"), MODULE_TAGS), F.lit(DEFAULT_TAG))
    both = both.withColumn("protocol_tag", tag)
    drugs = F.array(F.struct(F.lit("acetaminofén").alias("name"), F.lit("1 g").alias("dose")), F.struct(F.lit("cefalexina").alias("name"), F.lit("500 mg").alias("dose")))
    return {
        "patients": both.select(F.col("paciente_id").alias("id"), F.col("nombre").alias("full_name"), F.col("documento").alias("documento_cc")),
        "surgeries": both.select(F.col("paciente_id").alias("patient_id"), F.col("procedimiento").alias("procedure_name"), "protocol_tag"),
        "medications": both.select(F.col("paciente_id").alias("patient_id"), F.explode(drugs).alias("d")).select("patient_id", "d.*"),
        "appointments": both.select(F.col("paciente_id").alias("patient_id"), F.lit("control").alias("purpose"), F.lit("scheduled").alias("status")),
    }


GOLDEN = "id string, pregunta string, documento_esperado string, seccion_esperada string, palabras_clave array<string>"


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    """Question specifications from a JSON array."""
    return spark.read.schema(GOLDEN).option("multiLine", True).json(path)


def lenient_citation(body: Column) -> Column:
    """Citation from JSON under any of its keys; what has the wrong type or isn't JSON becomes the default."""
    v = F.try_parse_json(body)
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    name = F.coalesce(*(get(f"$.{k}", "string") for k in ("filename", "documento", "source")), F.lit(""))
    heading = F.coalesce(*(get(f"$.{k}", "string") for k in ("heading", "seccion")))
    page = F.coalesce(*(get(f"$.{k}", "int") for k in ("page", "pagina")))
    return F.struct(get("$.id", "string").alias("id"), name.alias("filename"), heading.alias("heading"), page.alias("page"))


def lenient_turns(body: Column) -> Column:
    """Number of turns: turnos may be a number or a list."""
    v = F.try_parse_json(body)
    return F.coalesce(F.try_variant_get(v, "$.turnos", "int"), F.size(F.try_variant_get(v, "$.turnos", "array<variant>")), F.lit(0))


def encode_columns(turns: DataFrame) -> DataFrame:
    """citations, latencies and survey as JSON text."""
    return turns.withColumns({c: F.to_json(c) for c in ("citations", "latencies", "survey") if c in turns.columns})


def decode_columns(turns: DataFrame) -> DataFrame:
    kinds = {"citations": CITATIONS, "latencies": LATENCIES, "survey": SURVEY}
    return turns.withColumns({c: F.from_json(c, t) for c, t in kinds.items() if c in turns.columns})


def write_metrics(metrics: DataFrame, detail: DataFrame, folder: str) -> None:
    """Overall metrics and rows for each question as JSON."""
    metrics.write.mode("overwrite").json(f"{folder}/metrics")
    detail.write.mode("overwrite").json(f"{folder}/detail")

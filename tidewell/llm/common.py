"""What the operators of this package share: tables, shared folders, small column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere in this package: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return jdir.get()
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there and no lost executor takes it along."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """df as a table in the shared folder, bucketed by a key: aggregates and joins by that key read it without another shuffle."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    label = f"{name}_{path[-32:]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(F.col(key)).write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(label)
    return spark.table(label)


#: Rows and bytes of whole texts that one Arrow batch takes to a Python worker, where its usual number of rows would fill the memory.
TEXT_ROWS, TEXT_BYTES = 1_000, 16 << 20


@contextmanager
def text_batches(spark: SparkSession, rows: int = TEXT_ROWS, size: int = TEXT_BYTES) -> Iterator[None]:
    """Actions inside send at most so many rows in an Arrow batch, which ends with the row that reaches so many bytes; less if the
    session says so."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {key: spark.conf.get(key, None) for key in limits}
    for key, most in limits.items():
        had = before[key] or ""
        spark.conf.set(key, str(min(most, int(had)) if had.isdigit() and int(had) > 0 else most))
    try:
        yield
    finally:
        for key, had in before.items():
            spark.conf.unset(key) if had is None else spark.conf.set(key, had)


#: Rows of one range of neighbouring ids, and the most ranges.
BUCKET_ROWS, MOST_BUCKETS = 2_000, 4_096


def id_bounds(df: DataFrame, column: str) -> list[int]:
    """Sorted quantiles of an id column that cut the rows into ranges of about BUCKET_ROWS; MOST_BUCKETS ranges at most."""
    ids = df.select(F.col(column).cast("long").alias("i"))
    parts = min(MOST_BUCKETS, max(1, ids.count() // BUCKET_ROWS))
    if parts < 2:
        return []
    found = ids.select(F.percentile_approx("i", [k / parts for k in range(1, parts)], 100 * parts).alias("q")).first().q
    return sorted(set(found or []))


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds lie below the key, by binary search; 0 for null."""
    if not bounds:
        return F.lit(0)
    arr = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps, step = [], 1
    while step <= len(bounds):
        steps.insert(0, step)
        step *= 2

    def move(at: Column, by: Column) -> Column:
        to = at + by
        return F.when((to <= len(bounds)) & (F.element_at(arr, F.least(to, F.lit(len(bounds)))) < key), to).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), move)


def numbered(docs: DataFrame) -> DataFrame:
    """doc (a struct of all columns, whatever they are called) and row: a number for each row that every scan finds again.

    The number is made of the row's file and its place there, so it doesn't depend on how a scan is split or on executors
    that come and go. The list of files, which the driver has anyway, is broadcast. Rows that aren't read from files are
    written first.
    """
    try:
        meta = docs.metadataColumn("_metadata")
        docs.select(meta["row_index"])
    except AnalysisException:
        docs = written(docs, "rows")
        meta = docs.metadataColumn("_metadata")
    paths = sorted(r.path for r in docs.select(meta["file_path"].alias("path")).distinct().collect())
    files = docs.sparkSession.createDataFrame([*enumerate(paths)], "file long, path string")
    placed = docs.select(F.struct("*").alias("doc"), meta["file_path"].alias("path"), meta["row_index"].alias("n"))
    return placed.join(F.broadcast(files), "path").select("doc", (F.shiftleft("file", 40) + F.col("n")).alias("row"))


def words(text: Column) -> Column:
    """Words of a text, none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def hex64(value: Column) -> Column:
    """16 lower-case hex digits of a long, read as unsigned."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")

"""Running streams over files to their end."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def files(spark: SparkSession, path: str, each: int | None = 1) -> DataFrame:
    """A stream of the Parquet files at a path, so many in a batch.

    None: all that are there in the first batch. So a table at rest is read whose files lie in no order of time: batch by batch the
    watermark would pass rows of files that are still to come.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if each is not None:
        reader = reader.option("maxFilesPerTrigger", each)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    # a stream reads folders: the one file is picked out of its own
    return reader.option("pathGlobFilter", at.getName()).parquet(str(at.getParent().toString()))


def folder(spark: SparkSession) -> str:
    """A new folder under the shared one; a temporary one only where none is named."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"


#: Where streams keep their state: on the executors' disks with change logs in the checkpoint, not in their heaps.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def started(writer, spark: SparkSession) -> StreamingQuery:
    """Starts a stream's writer with its state in STORE; the session's own setting is as before afterwards."""
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        return writer.start()
    finally:
        if before is None:
            spark.conf.unset(STORE[0])
        else:
            spark.conf.set(STORE[0], before)


def to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream over files gives once all that is there has been read; a restart goes on from its checkpoint."""
    spark = stream.sparkSession
    at = folder(spark)
    writer = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    started(writer, spark).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def split_late(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The result of an operator of streaming.ending, and the rows that came too late for it, as JSON."""
    return rows.filter("not late").drop("late", "late_row"), rows.filter("late").select("late_row")

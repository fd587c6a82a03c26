"""Life of documents: current state, versions, publishing, forgetting, change feed; data side of the job queue."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.config import SETTINGS

VISIBLE = ("status", "chunks", "embedded", "pages", "error")
IN_FLIGHT = ("parsing", "chunking", "embedding")


def current_state(events: DataFrame) -> DataFrame:
    """Latest event of each document (document_id, id, event, ...)."""
    rest = [c for c in events.columns if c != "document_id"]
    return events.groupBy("document_id").agg(F.max_by(F.struct(*rest), "id").alias("s")).select("document_id", "s.*")


def superseded(docs: DataFrame, order: str = "promoted") -> DataFrame:
    """One ready document for each digest: the newest; older ones are superseded, each knows the one before it."""
    w = Window.partitionBy("sha256").orderBy(order)
    newest = F.row_number().over(Window.partitionBy("sha256").orderBy(F.desc(order))) == 1
    return docs.select("*", F.when(newest, "ready").otherwise("superseded").alias("new_status"), F.lag("id").over(w).alias("supersedes_id"))


def forget(requests: DataFrame, docs: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remaining documents, remaining chunks, and one audit row for each distinct request with the real number of chunks."""
    asked = requests.select("id").distinct()
    counts = chunks.join(asked, chunks.document_id == asked.id, "left_semi").groupBy("document_id").agg(F.count("*").alias("n"))
    known = docs.select("id").withColumn("known", F.lit(True))
    audit = asked.join(known, "id", "left").join(counts, asked.id == counts.document_id, "left")
    audit = audit.select(asked.id, F.when(F.col("known"), "deleted").otherwise("not_found").alias("outcome"), F.when(F.col("known"), F.coalesce("n", F.lit(0))).otherwise(0).alias("chunks_deleted"))
    return docs.join(asked, "id", "left_anti"), chunks.join(asked, chunks.document_id == asked.id, "left_anti"), audit


def publish(tables: dict[str, DataFrame], root: str) -> str:
    """Writes the tables as a new immutable snapshot, then lets the manifest name it in one step.

    Readers resolve the manifest once, so they see a snapshot whole or not at all; of several publishers at once each gets a number.
    """
    spark = next(iter(tables.values())).sparkSession
    snapshot = f"{root}/snapshots/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{snapshot}/{name}")
    record(spark, root, lambda _: {"snapshot": snapshot})
    return snapshot


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _claimed(spark: SparkSession, path: str, text: str) -> bool:
    """Lets a file with the text appear at a path in one step; false if somebody else's is there."""
    at, fs = _path(spark, path)
    draft, _ = _path(spark, f"{path}.{uuid.uuid4().hex}.draft")
    fs.mkdirs(at.getParent())
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.exists(at):
            return False
        if fs.getScheme() != "file":
            return fs.rename(draft, at)  # distributed file systems don't replace a file by rename
        file = lambda p: spark._jvm.java.io.File(p.toUri().getPath()).toPath()
        spark._jvm.java.nio.file.Files.createLink(file(at), file(draft))
        return True
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    finally:
        fs.delete(draft, False)


def _manifests(spark: SparkSession, root: str) -> list[str]:
    """Manifests, oldest first."""
    at, fs = _path(spark, f"{root}/manifests/*.json")
    return sorted(str(f.getPath().toString()) for f in fs.globStatus(at) or [])


def _body(spark: SparkSession, manifest: str) -> dict:
    return json.loads(spark.read.text(manifest, wholetext=True).first().value)


def newest(spark: SparkSession, root: str) -> dict | None:
    """What the newest manifest under a root says; none if there is no manifest."""
    found = _manifests(spark, root)
    return _body(spark, found[-1]) if found else None


def record(spark: SparkSession, root: str, make: Callable[[dict | None], dict]) -> dict:
    """Writes make(newest manifest) as the next one by compare-and-swap: if another writer was first, make sees theirs and tries again."""
    while True:
        found = _manifests(spark, root)
        n = int(found[-1].rsplit("/", 1)[1].removesuffix(".json")) + 1 if found else 0
        body = make(_body(spark, found[-1]) if found else None)
        if _claimed(spark, f"{root}/manifests/{n:012d}.json", json.dumps(body)):
            return body


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the newest published snapshot."""
    found = newest(spark, root)
    if found is None:
        raise LookupError(f"nothing has been published under {root}")
    return spark.read.parquet(f"{found['snapshot']}/{name}")


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Removes the snapshots of all but the newest manifests, and gives them.

    Only snapshots that a manifest named are touched, so what a publisher is still writing stays; keep bounds how long a reader may
    go on with what it resolved. Manifests stay, as the record.
    """
    named = [_body(spark, m)["snapshot"] for m in _manifests(spark, root)]
    old = [s for s in dict.fromkeys(named[:-keep]) if s not in named[-keep:]]
    gone = []
    for snapshot in old:
        at, fs = _path(spark, snapshot)
        if fs.delete(at, True):
            gone.append(snapshot)
    return gone


def snapshot_diff(before: DataFrame, after: DataFrame, visible: tuple[str, ...] = VISIBLE) -> DataFrame:
    """id, change: documento where a visible column differs or is new, eliminado where the document went."""
    pack = lambda df, name: df.select("id", F.struct(*visible).alias(name))
    both = pack(before, "old").join(pack(after, "new"), "id", "full_outer")
    change = F.when(F.col("new").isNull(), "eliminado").when(~F.col("old").eqNullSafe(F.col("new")), "documento")
    return both.select("id", change.alias("change")).filter("change is not null")


def since(docs: DataFrame, events: DataFrame, mark: str | None) -> DataFrame:
    """Documents updated at the mark or later and distinct deletions since; everything without a mark that is a time."""
    at = F.try_to_timestamp(F.lit(mark))
    changed = docs.filter(at.isNull() | (F.col("updated_at") >= at)).select("id", F.lit("documento").alias("change"))
    gone = events.filter((F.col("event") == "deleted") & at.isNotNull() & (F.col("created_at") >= at)).select(F.col("document_id").alias("id"), F.lit("eliminado").alias("change")).distinct()
    return changed.unionByName(gone)


def bury_stuck(jobs: DataFrame, docs: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Jobs that ran out of attempts under a lease that has ended fail, and their documents if still under way."""
    stuck = jobs.filter((F.col("status") == "running") & (F.col("attempts") >= F.col("max_attempts")) & (F.col("locked_at") < now - F.expr(f"INTERVAL {SETTINGS.lease_minutes} MINUTES")))
    ids = stuck.select(F.col("document_id").alias("id")).distinct().withColumn("stuck", F.lit(True))
    hit = F.coalesce("stuck", F.lit(False)) & F.col("status").isin(*IN_FLIGHT)
    failed = docs.join(ids, "id", "left").select("id", F.when(hit, "failed").otherwise(F.col("status")).alias("status"), F.when(hit, "the job ran out of attempts").alias("error"))
    return stuck.select("id", F.lit("failed").alias("status")), failed


def real_failures(failures: DataFrame, catalog: DataFrame) -> DataFrame:
    """Failures of documents that still exist, message cut to 500 characters; a document deleted meanwhile is no error."""
    return failures.join(catalog.select(F.col("id").alias("document_id")), "document_id", "left_semi").select("document_id", F.substring("message", 1, 500).alias("error"))


#: Events of an id, by number, that are put in order together, as a power of two: an id with very many is spread over tasks.
FEED_BITS = 12


def apply_feed(listed: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A materialised list after the events of each id in order, field by field, and the ids that the list doesn't know.

    listed: id, status, chunks, error. events: id, seq, change, status, chunks, error. A field that an event lacks (null) keeps its
    value, but for the error, which only stays while the status is failed. A deletion takes the row away; what comes for its
    id later, as for one that was never listed, is reported as unknown. Events of an id have distinct numbers; a repeated event changes
    nothing. Rows without an event stay as they are.
    """
    e = events.filter("id is not null and seq is not null").withColumn("block", F.shiftright("seq", FEED_BITS))
    told = F.col("change") == "documento"
    gone = e.filter(~told).groupBy("id").agg(F.max("seq").alias("gone"))
    e = e.filter(told)
    # the status at each event: the last one told in its block, or before its block; null where only the list knows it
    before = Window.partitionBy("id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("id", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    starts = e.groupBy("id", "block").agg(F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))).alias("s")).select("id", "block", F.last("s", True).over(before).alias("started"))
    at = e.withColumn("own", F.last("status", True).over(inside)).join(starts, ["id", "block"]).withColumn("now", F.coalesce("own", "started"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    clears = F.col("error").isNull()
    folded = at.groupBy("id").agg(
        last("status").alias("new_status"), last("chunks").alias("new_chunks"), last("error").alias("new_error"), F.max(F.when(~clears, F.col("seq"))).alias("set_at"),
        F.max(F.when(clears & (F.col("now") != "failed"), F.col("seq"))).alias("cleared"), F.max(F.when(clears & F.col("now").isNull(), F.col("seq"))).alias("cleared_if"), F.max("seq").alias("newest"),
    )
    both = listed.withColumn("known", F.lit(True)).join(folded, "id", "full_outer").join(gone, "id", "left")
    unknown = both.filter(F.col("newest").isNotNull() & (F.col("known").isNull() | (F.col("newest") > F.col("gone")))).select("id")
    cleared = F.greatest("cleared", F.when(~F.col("status").eqNullSafe("failed"), F.col("cleared_if")))
    error = F.when(F.col("set_at") > F.coalesce(cleared, F.col("set_at") - 1), F.col("new_error")).when(cleared.isNull() & F.col("set_at").isNull(), F.col("error"))
    kept = both.filter(F.col("known") & F.col("gone").isNull())
    return kept.select("id", F.coalesce("new_status", "status").alias("status"), F.coalesce("new_chunks", "chunks").alias("chunks"), error.alias("error")), unknown


def feed_sink(spark: SparkSession, root: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the published list under a root (tables listed and unknown) up with a feed.

    The manifest names the batch that it has applied, so a batch that is run again after a failure, or twice, changes nothing.
    """

    def put(batch: DataFrame, number: int) -> None:
        now = newest(spark, root)
        if now is None:
            raise LookupError(f"no list has been published under {root}")
        if now.get("batch", -1) >= number:
            return
        listed, unknown = apply_feed(spark.read.parquet(f"{now['snapshot']}/listed"), batch)
        snapshot = f"{root}/snapshots/{uuid.uuid4().hex}"
        listed.write.parquet(f"{snapshot}/listed")
        unknown.unionByName(spark.read.parquet(f"{now['snapshot']}/unknown")).distinct().write.parquet(f"{snapshot}/unknown")
        record(spark, root, lambda found: {"snapshot": snapshot, "batch": number} if found.get("batch", -1) < number else found)

    return put


def claimable(jobs: DataFrame, now: Column) -> DataFrame:
    lease = now - F.expr(f"INTERVAL {SETTINGS.lease_minutes} MINUTES")
    ready = (F.col("status") == "queued") & (F.col("run_after") <= now) | (F.col("status") == "running") & (F.col("locked_at") < lease)
    return jobs.filter((F.col("attempts") < F.col("max_attempts")) & ready).orderBy("id")


def retries(jobs: DataFrame, now: Column) -> DataFrame:
    """State and next run of each failed job: two to the attempts seconds later, 300 at most."""
    wait = F.least(F.pow(F.lit(2.0), F.col("attempts")), F.lit(300.0)).cast("int")
    again = F.col("retryable") & (F.col("attempts") < F.col("max_attempts"))
    return jobs.select("id", F.when(again, "queued").otherwise("failed").alias("status"), wait.alias("wait_s"), F.when(again, now + F.make_interval(secs=wait)).alias("run_after"))

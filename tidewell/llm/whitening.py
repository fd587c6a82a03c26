"""Embedding whitening by a bidiagonal qd solver over a blockwise QR.

Vectors become integers on a grid, so that their sums are exact whatever the order. Each task reduces its centred rows, block by
block, to one triangle R by QR; triangles meet FAN_IN at a time until one is left, whose size is the dimension squared. The driver turns
it into bidiagonal form, finds its singular values by dqds and the directions by twisted factorisations (llm.qd); tasks then project
their rows. The covariance of the whitened rows is measured in a pass of its own, with partial moments merged by Chan's rule.

Defined cases: rows whose vector is null, or has null or non-finite entries, are left out; of vectors with different dimensions the most
frequent one (of ties the larger) counts and the others are left out; grid values beyond 2^53 are cut to it; a component whose
variance is nothing but rounding (rank) is not returned, so equal vectors alone give no rows; a deviation beyond a long is null; repeated
rows and null vec_ids count like others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import table, written
from tidewell.llm.qd import right_singular

#: Grid of the entries, components, rows of a QR block, partial results that meet in a task.
STEPS, OFFSET, COMPONENTS, BLOCK_ROWS, FAN_IN = 1024, 100_000, 8, 4_096, 32


def usable(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, vec (doubles) of the rows that can be used, and their dimension (0 without rows)."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.filter(v.isNotNull() & finite).select("vec_id", v.cast("array<double>").alias("vec"))
    top = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (rows.filter(F.size("vec") == top.d), top.d) if top else (rows, 0)


def grid(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    """The integer rows of a batch of vectors."""
    flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
    # beyond this the sums of long columns would not be exact
    return np.clip(np.floor(flat * STEPS), -(2.0**53), 2.0**53).astype(np.int64) + OFFSET


def reduced(parts: DataFrame, merge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """Arrays of equal shape (at, part) merged to one, FAN_IN at a time; each round is a table, so a lost task repeats little."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for part in batch.column("part"):
                a = np.array(part.as_py(), float)
                now = a if now is None else merge(now, a)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now.tolist()], pa.list_(pa.float64()))], ["part"])

    parts = written(parts, "parts")
    while (n := parts.count()) > 1:
        parts = written(parts.repartition(max(1, -(-n // FAN_IN))).mapInArrow(run, "part array<double>"), "parts")
    row = parts.first()
    return None if row is None else np.array(row.part)


def exact_sums(rows: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """How many rows, and the sum of each dimension's grid values, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dimension
        for batch in batches:
            x = grid(batch, dimension)
            n, total = n + len(x), [t + int(s) for t, s in zip(total, x.sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([list(map(str, total))])], ["n", "sums"])

    # a row for each task and dimension
    parts = rows.select("vec").mapInArrow(run, "n long, sums array<string>")
    sums = parts.select("n", F.posexplode("sums").alias("k", "s")).groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("k").collect()
    return int(sums[0].n), [int(r.s) for r in sums]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n with one rounding where n * x fits a long, else from whole parts and remainders of S / n."""
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n / n for s in sums])
    return (x - whole).astype(float) - rest


def triangle(rows: DataFrame, dimension: int, n: int, sums: list[int]) -> np.ndarray:
    """R of the QR of all centred rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dimension))
        for batch in batches:
            x = centred(grid(batch, dimension), n, sums)
            for at in range(0, len(x), BLOCK_ROWS):
                r = np.linalg.qr(np.vstack([r, x[at : at + BLOCK_ROWS]]), mode="r")
        if len(r):
            r = np.vstack([r, np.zeros((dimension - len(r), dimension))])
            yield pa.RecordBatch.from_arrays([pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], ["part"])

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.linalg.qr(np.vstack([a.reshape(-1, dimension), b.reshape(-1, dimension)]), mode="r").ravel()

    return reduced(rows.select("vec").mapInArrow(run, "part array<double>"), merge).reshape(-1, dimension)


def moments(rows: DataFrame, project: Callable[[pa.RecordBatch], np.ndarray], k: int) -> np.ndarray:
    """Covariance (divisor n) of the k projected columns, each block centred before it is multiplied."""

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = a[0] + b[0]
        apart = b[1 : k + 1] - a[1 : k + 1]
        mean = a[1 : k + 1] + apart * (b[0] / n)
        second = a[k + 1 :] + b[k + 1 :] + (np.outer(apart, apart) * (a[0] * b[0] / n)).ravel()
        return np.concatenate([[n], mean, second])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            if len(w := project(batch)):
                mean = w.mean(axis=0)
                part = np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()])
                now = part if now is None else merge(now, part)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now.tolist()], pa.list_(pa.float64()))], ["part"])

    found = reduced(rows.select("vec").mapInArrow(run, "part array<double>"), merge)
    return found[k + 1 :].reshape(k, k) / found[0]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n x - S)^2, in whole numbers; none where it is beyond a long."""
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    apart = x - whole
    bound = (float(np.abs(apart).max(initial=0)) + 1) * n
    if bound**2 * x.shape[1] < 2**62:
        return ((apart * n - rest) ** 2).sum(axis=1).tolist()
    exact = [sum((int(a) * n - int(r)) ** 2 for a, r in zip(row, rest, strict=True)) for row in apart]
    return [v if v < 2**63 else None for v in exact]


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every usable row and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = embeddings.sparkSession
    rows, dimension = usable(embeddings)
    if not dimension:
        return spark.createDataFrame([], schema)
    n, sums = exact_sums(rows, dimension)
    r = triangle(rows, dimension, n, sums)
    squares, directions = right_singular(r, components, n)
    k = len(squares)
    if not k:
        return spark.createDataFrame([], schema)
    trace = float((r**2).sum())
    scaled = directions / np.sqrt(squares / n)
    explained = squares / trace

    def project(batch: pa.RecordBatch) -> np.ndarray:
        return centred(grid(batch, dimension), n, sums) @ scaled

    error = float(np.abs(moments(rows, project, k) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x, w = batch.column("vec_id"), grid(batch, dimension), project(batch)
            m = len(x)
            long = pa.array(np.repeat(np.arange(m), k))
            out = [ids.cast(pa.int64()).take(long), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(deviations(x, n, sums), pa.int64()).take(long), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(out, schema=pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]))

    return rows.mapInArrow(run, schema)


def op13_bidiagonal_qd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector projected on the first eight components of the covariance, whitened."""
    return whitened(table(spark, sf_dir, "embeddings"))

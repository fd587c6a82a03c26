"""SimHash near-duplicates with vantage-point trees.

Fingerprints are 64 bits over hashed word shingles. Distinct fingerprints are split by their Hamming distance from vantage
points: a node of the tree keeps those within its radius on one side and the rest on the other, and the pairs across are
looked for only between the two bands within three bits of the radius, which the triangle inequality allows to be close.
The upper levels of the tree name shards, which Spark shuffles; each shard goes on with the same splits in memory. The
vantage points are fixed hashes; the radii of the upper levels are medians of a bounded sample, which steers only the
balance of the shards: every fingerprint is indexed and no link is lost.

A shard returns a spanning forest of its links instead of all pairs, so that a large group of near copies costs as many
rows as it has members. Copies with equal fingerprints are one member.

Defined cases: a null or empty text has no words and the fingerprint zero, which is linked like any other; a text of fewer
words than a shingle is one shingle; rows with the same doc_id or text are each returned; a null doc_id is returned, and a
component of null ids alone has a null component_id; an empty table gives an empty result; other columns are kept by
kept_documents(), and their names are no matter, since working columns stand beside a struct of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import hex64, numbered, table, written
from tidewell.llm.graph import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Distinct fingerprints that a shard of the upper tree holds on average, the sample that sets its radii, its deepest level.
SHARD_ROWS, SAMPLE, DEEPEST = 40_000, 4_096, 9
#: Comparisons that a node makes outright.
LEAF = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of one text, as an unsigned number."""
    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not ws:
        return 0
    if len(ws) <= shingle:
        parts = [b" ".join(ws)]
    else:
        lines = b" ".join(ws)
        ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: len(ws) - shingle + 1]
        parts = map(lines.__getitem__, map(slice, starts.tolist(), (ends[shingle - 1 :] - 1).tolist()))
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(p, seed) for p in parts], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        block = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (long) of docs (doc_id, text)."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": np.array([fingerprint(t, shingle) for t in b["text"]], np.uint64).view(np.int64)})

    return docs.select("doc_id", "text").mapInPandas(of, "doc_id long, fp long")


def _vantage(path: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(path, 7))


def _split(a: np.ndarray, b: np.ndarray | None, vantage: np.uint64, mid: int | None) -> tuple[list[tuple], int]:
    """The parts of a node: (name, left, right), right None where pairs within left are looked for. a, b: fingerprints."""
    da = np.bitwise_count(a ^ vantage).astype(np.int16)
    if b is None:
        mid = int(np.median(da)) if mid is None and len(da) else 32 if mid is None else mid
        near = da <= mid
        return [("i", near, None), ("o", ~near, None), ("x", near & (da > mid - RADIUS), ~near & (da <= mid + RADIUS))], mid
    db = np.bitwise_count(b ^ vantage).astype(np.int16)
    if mid is None:
        both = np.concatenate((da, db))
        mid = int(np.median(both)) if len(both) else 32
    na, nb = da <= mid, db <= mid
    return [("i", na, nb), ("o", ~na, ~nb), ("x", na & (da > mid - RADIUS), ~nb & (db <= mid + RADIUS)), ("y", ~na & (da <= mid + RADIUS), nb & (db > mid - RADIUS))], mid


def _walk(a: np.ndarray, b: np.ndarray | None, depth: int, mids: dict[str, int], learn: bool, path: str = "", ia=None, ib=None) -> Iterator[tuple[str, np.ndarray, np.ndarray | None]]:
    """Shards of the upper tree: path and the row numbers on its sides. learn: set the radii as medians of what is given."""
    ia = np.arange(len(a)) if ia is None else ia
    if depth == 0:
        yield path, ia, ib
        return
    parts, mid = _split(a, b, _vantage(path), None if learn else mids.get(path, 32))
    if learn:
        mids[path] = mid
    for name, left, right in parts:
        if b is None and right is not None:
            yield from _walk(a[left], a[right], depth - 1, mids, learn, path + name, ia[left], ia[right])
        elif right is None:
            yield from _walk(a[left], None, depth - 1, mids, learn, path + name, ia[left], None)
        else:
            yield from _walk(a[left], b[right], depth - 1, mids, learn, path + name, ia[left], ib[right])


class Forest:
    """Least member of each group, while links come in."""

    def __init__(self, n: int) -> None:
        self.root, self.waiting, self.held = np.arange(n), [], 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.waiting.append((i, j))
        self.held += len(i)
        if self.held > 1 << 18:
            self.settle()

    def settle(self) -> np.ndarray:
        if self.waiting:
            i, j = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
            r = self.root
            while True:
                while not np.array_equal(r, up := r[r]):
                    r = up
                ri, rj = r[i], r[j]
                open_ = ri != rj
                if not open_.any():
                    break
                i, j, ri, rj = i[open_], j[open_], ri[open_], rj[open_]
                r = r.copy()
                np.minimum.at(r, np.maximum(ri, rj), np.minimum(ri, rj))
            self.root, self.waiting, self.held = r, [], 0
        return self.root


def _pairs(fps: np.ndarray, ia: np.ndarray, ib: np.ndarray | None, forest: Forest, path: str, level: int = 0) -> None:
    """Links at RADIUS or fewer bits among ia, or between ia and ib, into the forest."""
    n, m = len(ia), len(ia) if ib is None else len(ib)
    if n == 0 or m == 0 or (ib is None and n < 2):
        return
    if n * m > LEAF and level < 60:
        parts, _ = _split(fps[ia], None if ib is None else fps[ib], _vantage(path + str(level)), None)
        sizes = [int(left.sum()) * int((left if right is None else right).sum()) for _, left, right in parts]
        if sum(sizes) < n * m:  # else the vantage point tells nothing apart
            for name, left, right in parts:
                other = None if right is None else (ia if ib is None else ib)[right]
                _pairs(fps, ia[left], other, forest, path + name, level + 1)
            return
    right = ia if ib is None else ib
    step = max(1, (1 << 20) // m)
    for at in range(0, n, step):
        left = ia[at : at + step]
        i, j = np.nonzero(np.bitwise_count(fps[left][:, None] ^ fps[right][None, :]) <= RADIUS)
        forest.add(left[i], right[j])


def links(fps: DataFrame) -> DataFrame:
    """a, b: a spanning forest, shard by shard, of the links between the distinct fingerprints of fps (fp long)."""
    n = fps.count()
    depth = min(DEEPEST, max(0, math.ceil(math.log2(max(1, n) / SHARD_ROWS))))
    mids: dict[str, int] = {}
    if depth:
        sample = fps.select("fp", F.xxhash64("fp").alias("h")).orderBy("h").limit(SAMPLE)
        known = np.array([r.fp for r in sample.collect()], np.int64).view(np.uint64)
        for _ in _walk(known, None, depth, mids, learn=True):
            pass

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            a = b["fp"].to_numpy(np.int64)
            for path, ia, ib in _walk(a.view(np.uint64), None, depth, mids, learn=False):
                for side, rows in ((0, ia), (1, ib)):
                    if rows is not None and len(rows):
                        yield pd.DataFrame({"shard": path, "side": side, "fp": a[rows]})

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = rows["fp"].to_numpy(np.int64)
        fp, at = np.unique(found, return_inverse=True)
        forest = Forest(len(fp))
        side = rows["side"].to_numpy()
        crossing = key[0][-1:] in ("x", "y") or "x" in key[0] or "y" in key[0]
        ia = at[side == 0]
        _pairs(fp.view(np.uint64), ia, at[side == 1] if crossing else None, forest, key[0])
        root = forest.settle()
        own = np.nonzero(root != np.arange(len(fp)))[0]
        return pd.DataFrame({"a": fp[own], "b": fp[root[own]]})

    return fps.select("fp").mapInPandas(route, "shard string, side int, fp long").groupBy("shard").applyInPandas(solve, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, find: Callable[[DataFrame], DataFrame] = links) -> DataFrame:
    """doc_id, fp, component_id of each row of docs (doc_id, text)."""
    prints = written(with_fingerprints(docs, shingle), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(find(distinct.select("fp").checkpoint())).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def kept_documents(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs without the near copies: of each group only the row with its smallest doc_id, nulls last, the first on a tie."""
    rows = numbered(docs)
    keys = rows.select("row", F.col("doc.doc_id").isNull().alias("last"), F.col("doc.doc_id").alias("id"))
    found = near_duplicates(rows.select(F.col("row").alias("doc_id"), "doc.text"), shingle).select(F.col("doc_id").alias("row"), "component_id")
    first = found.join(keys, "row").groupBy("component_id").agg(F.min(F.struct("last", "id", "row")).alias("k")).select(F.col("k.row").alias("row"))
    return rows.join(first, "row", "left_semi").select("doc.*")


def op10_vantage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")

"""Connected components of an edge table, by alternating stars with checkpoints between rounds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges of a task: a small graph is handled by few tasks, which write few shuffle files in each of the many short steps.
TASK_EDGES = 200_000


def _stars(pairs: DataFrame, tasks: int) -> DataFrame:
    """Every (u, v) leads both to the least of u's neighbourhood; pairs: each node u with neighbours v."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(tasks)
    return pairs.join(least, "u").coalesce(tasks)


def components(edges: DataFrame) -> DataFrame:
    """node, root for the edges (a, b): root is the least node that can be reached. Nodes without an edge are not listed.

    Nulls, loops and repeated edges don't count. A round is two joins by node; a node with very many neighbours is
    pre-aggregated before the shuffle and its join is split by adaptive execution. Rounds grow with the logarithm of a
    component's width.
    """
    now = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    tasks, last = max(1, math.ceil(now.count() / TASK_EDGES)), None
    now = now.coalesce(tasks)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both.coalesce(tasks), tasks).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _stars(large, tasks)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        now = small.coalesce(tasks).checkpoint()
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = mark

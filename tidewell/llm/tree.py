"""Totals of every subtree of a forest by parallel tree contraction: leaves are raked, unary chains compressed, then re-expanded.

A phase of the contraction is a few joins by node whatever the shape of the trees. Compress takes out every node with one child:
its pointer down the chain doubles in join rounds until it stands on the first node with another number of children, so that
T(node) = T(that node) + what was passed; the top of the chain hands its place, and the sum, to the bottom. Rake takes out every
leaf, whose total is settled, and adds it to its parent. After compress each node left has no child or two and more, so a rake
takes at least half of them: phases grow with the logarithm of the nodes, rounds of a phase with that of its longest chain. At the
end the compressed nodes of each phase, last phase first, look up the totals that their chains lead to.

A node with very many children is no hot spot: children are counted and added by aggregates, which Spark sums in each task first, and
all joins are between tables with one row a node. Every step is cut with checkpoint(), so a lost executor costs the step.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes of a task: the late phases have few nodes, which few tasks handle.
TASK_NODES = 200_000


def _cut(df: DataFrame, tasks: int) -> DataFrame:
    return df.coalesce(tasks).checkpoint()


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def chains(unary: DataFrame, values: list[str], tasks: int) -> list[DataFrame]:
    """id, up, to, hops, values of each node with one child: where its chain ends and the sum of what it passes, in parts.

    unary: id, up, to (the child), values (what the step to the child adds). A row is open while its pointer stands on a node
    with one child; the join takes it over all that its target has passed already.
    """
    known = unary.select(F.col("id").alias("to"), F.lit(True).alias("open"))
    parts, now = [], _cut(unary.withColumn("hops", F.lit(1).cast("long")).join(known, "to", "left").withColumn("open", F.coalesce("open", F.lit(False))), tasks)
    while True:
        parts.append(now.filter("not open").drop("open"))
        ahead = now.filter("open")
        if ahead.isEmpty():
            return parts
        targets = _union([p.withColumn("open", F.lit(False)) for p in parts] + [ahead])
        targets = targets.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("hops").alias("hops2"), F.col("open").alias("open2"), *(F.col(v).alias(f"{v}2") for v in values))
        joined = ahead.drop("open").join(targets, "to")
        now = _cut(joined.select("id", "up", F.col("to2").alias("to"), (F.col("hops") + F.col("hops2")).alias("hops"), F.col("open2").alias("open"), *((F.col(v) + F.col(f"{v}2")).alias(v) for v in values)), tasks)


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """id and values for every node: each value (long) summed over the node's subtree, itself included.

    tree: id (of any type that can be ordered), parent (null, or no id of the table, for roots), values. Ids are distinct and not
    null; parents make no circle. A null value counts as 0; an empty table gives an empty one.
    """
    over = {v: f"over_{v}" for v in values}  # what lies on the edge above a node, of nodes that were taken out there
    live = _cut(tree.select("id", F.col("parent").alias("up"), *(F.coalesce(F.col(v).cast("long"), F.lit(0)).alias(v) for v in values), *(F.lit(0).cast("long").alias(o) for o in over.values())), int(tree.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    raked, compressed = [], []
    while n := live.count():
        tasks = max(1, math.ceil(n / TASK_NODES))
        below = live.filter("up is not null").groupBy(F.col("up").alias("id")).agg(F.count("*").alias("kids"), F.min(F.struct("id", *over.values())).alias("only"))
        state = _cut(live.join(below, "id", "left").withColumn("kids", F.coalesce("kids", F.lit(0))), tasks)
        unary = state.filter("kids = 1")
        rest = state.filter("kids != 1").drop("only")
        parts = []
        if not unary.isEmpty():
            parts = chains(unary.select("id", F.struct("up", *over.values()).alias("up"), F.col("only.id").alias("to"), *((F.col(v) + F.col(f"only.{o}")).alias(v) for v, o in over.items())), values, tasks)
            tops = _union(parts).groupBy(F.col("to").alias("id")).agg(F.max_by(F.struct("up", *values), "hops").alias("top"))
            rest = rest.join(tops, "id", "left")
            rest = rest.select("id", F.when(F.col("top").isNull(), F.col("up")).otherwise(F.col("top.up.up")).alias("up"), *values, *(F.when(F.col("top").isNull(), F.col(o)).otherwise(F.col(f"top.{v}") + F.col(f"top.up.{o}")).alias(o) for v, o in over.items()), "kids")
            rest = _cut(rest, tasks)
        compressed.append([p.drop("up", "hops") for p in parts])
        leaves = rest.filter("kids = 0")
        raked.append(leaves.select("id", *values))
        gain = leaves.filter("up is not null").groupBy(F.col("up").alias("id")).agg(*(F.sum(F.col(v) + F.col(o)).alias(f"{v}2") for v, o in over.items()))
        live = _cut(rest.filter("kids > 1").join(gain, "id", "left").select("id", "up", *((F.col(v) + F.coalesce(f"{v}2", F.lit(0))).alias(v) for v in values), *over.values()), tasks)
    known = []
    for leaves, parts in zip(reversed(raked), reversed(compressed), strict=True):
        known.append(leaves)
        if parts:
            ends = _union(known).select(F.col("id").alias("to"), *(F.col(v).alias(f"{v}2") for v in values))
            known.append(_union(parts).join(ends, "to").select("id", *((F.col(v) + F.col(f"{v}2")).alias(v) for v in values)).checkpoint())
    return _union(known) if known else live.select("id", *values)

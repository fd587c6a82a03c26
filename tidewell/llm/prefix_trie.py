"""The prefix trie of conversations: what each shared beginning would save, by parallel tree contraction over its nodes.

A node is a distinct sequence of first turns (role, text). Texts never leave the scan: a turn is its SHA-256 (first 128 bits) and its
number of code points. A prefix is known by its depth and two sums over its turns of 64-bit hashes of (depth, turn), so equal prefixes
have equal names and others differ but for a chance of about pairs / 2^128; a node's final name is its smallest member and its depth.
Running sums go through blocks of BLOCK neighbouring turns, so that a conversation with very many turns is spread over tasks.
Subtree totals come from llm.tree (rake and compress).

Defined cases: rows with a null conv_id belong to no conversation and are left out; a null turn comes first, turns with the same
number stand in order of their digest and repeated rows are turns of their own; a null role or text is an empty one; texts of any length
are only hashed and counted; an empty table has no node; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import table, written
from tidewell.llm.tree import subtree_totals

#: Turns of a block, as a power of two, and conv_ids of a piece of a node's list.
BLOCK_BITS, PIECE_IDS = 10, 256
#: The block of turns without a number, before all others.
FIRST_BLOCK = -(1 << 62)
#: First turns that a rebuilt conversation may take from the first one of its hundred.
HEADS = 5


def running(rows: DataFrame, order: list[str], values: list[str]) -> DataFrame:
    """rows (conv_id, block, ...) with each value replaced by its sum up to the row, in the order within conv_id; block goes.

    Blocks follow the order. Sums within a block are windows, those of the blocks before come from one row a block.
    """
    inside = Window.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "block").agg(*(F.sum(v).alias(v) for v in values))
    starts = totals.select("conv_id", "block", *(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"before_{v}") for v in values))
    rest = [c for c in rows.columns if c not in (*values, "block")]
    summed = rows.select(*rest, "block", *(F.sum(v).over(inside).alias(v) for v in values)).join(starts, ["conv_id", "block"])
    return summed.select(*rest, *((F.col(v) + F.col(f"before_{v}")).alias(v) for v in values))


def turn_digest(role: Column, text: Column) -> Column:
    """128 bits of the SHA-256 of role and text, where no other split of the same characters gives the same."""
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, nth (from 1), digest, chars of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_digest(role, text).alias("digest"), F.length(text).cast("long").alias("chars"))
    block = F.coalesce(F.shiftright("turn", BLOCK_BITS), F.lit(FIRST_BLOCK))
    return running(turns.select("*", block.alias("block"), F.lit(1).cast("long").alias("nth")), ["turn", "digest"], ["nth"]).drop("turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with its first h turns exchanged for those of conversation c - c % 100, h = crc32(decimal c) % 6.

    The remainder has the sign of c, as in SQL. Two tables: conv_id, nth, digest, chars of the turns, and conv_id, turns of all conversations, also those with none left.
    """
    ids = turns.groupBy("conv_id").agg(F.max("nth").alias("own"))
    ids = ids.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).withColumn("base", F.col("conv_id") - F.col("conv_id") % 100)
    heads = turns.filter((F.col("conv_id") % 100 == 0) & (F.col("nth") <= HEADS)).withColumnRenamed("conv_id", "base")
    there = heads.groupBy("base").agg(F.max("nth").alias("there"))
    ids = ids.join(there, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    ids = written(ids.withColumn("turns", F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("h"))), "conversations")
    copied = ids.join(heads, "base").filter("nth <= h").select("conv_id", "nth", "digest", "chars")
    own = turns.join(ids.select("conv_id", "h", "taken"), "conv_id").filter("nth > h").select("conv_id", (F.col("nth") - F.col("h") + F.col("taken")).alias("nth"), "digest", "chars")
    return copied.unionByName(own), ids.select("conv_id", "turns")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, chars, name (of the prefix that ends with the turn), up (of the one before it) for every turn."""
    hashed = lambda k: F.xxhash64(F.lit(k), F.col("nth"), F.col("digest")).cast("decimal(20,0)")
    rows = turns.select("conv_id", F.col("nth").alias("depth"), "chars", hashed(1).alias("own1"), hashed(2).alias("own2"), F.shiftright("nth", BLOCK_BITS).alias("block"))
    sums = running(rows.withColumns({"s1": F.col("own1"), "s2": F.col("own2")}), ["depth"], ["s1", "s2"])
    wide = lambda c: c.cast("decimal(38,0)")
    return sums.select("conv_id", "depth", "chars", *(wide(F.col(f"s{k}")).alias(f"s{k}") for k in (1, 2)), *(wide(F.col(f"s{k}") - F.col(f"own{k}")).alias(f"p{k}") for k in (1, 2)))


def list_digests(members: DataFrame, key: list[str]) -> DataFrame:
    """key, ends_sha256: SHA-256 of the decimal conv_ids of each key, ascending and joined by commas.

    Ids meet in pieces of PIECE_IDS neighbouring numbers first; the pieces of a key are then hashed one after the other, as they
    come sorted, so that no list is ever held.
    """
    # conv_ids are distinct within a key, so a piece has PIECE_IDS at most
    piece = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = members.groupBy(*key, F.floor(F.col("conv_id") / PIECE_IDS).alias("at")).agg(piece.alias("piece"), F.min("conv_id").alias("first")).drop("at")
    kinds = {f.name: f.dataType.simpleString() for f in members.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest = None, hashlib.sha256()
        for rows in batches:
            out = []
            for *k, text in rows[[*key, "piece"]].itertuples(index=False):
                if k != now:
                    if now is not None:
                        out.append((*now, digest.hexdigest()))
                    now, digest = k, hashlib.sha256(text.encode())
                else:
                    digest.update(f",{text}".encode())
            yield pd.DataFrame(out, columns=[*key, "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(*now, digest.hexdigest())], columns=[*key, "ends_sha256"])

    sorted_pieces = pieces.repartition(*key).sortWithinPartitions(*key, "first")
    return sorted_pieces.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in key) + ", ends_sha256 string")


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """All nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, nth (1, 2, ... without a gap), digest, chars; conversations: conv_id, turns (how many, 0 too).
    """
    rows = written(prefixes(turns), "prefixes")
    key = ["depth", "s1", "s2"]
    zero = F.lit(0).cast("decimal(38,0)")
    inner = rows.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    top = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    top = top.select(F.lit(0).cast("long").alias("depth"), zero.alias("s1"), zero.alias("s2"), "conv_id", "n_convs", F.lit(0).cast("long").alias("chars"), zero.alias("p1"), zero.alias("p2"))
    nodes = written(inner.unionByName(top), "nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("s1").alias("p1"), F.col("s2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    root = nodes.filter("depth = 0").select(F.col("conv_id").alias("parent_conv_id"))  # a row
    linked = nodes.filter("depth > 1").join(above, ["depth", "p1", "p2"]).unionByName(nodes.filter("depth = 1").crossJoin(F.broadcast(root)))
    linked = linked.unionByName(nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    node, parent = F.struct("conv_id", "depth"), F.when(F.col("depth") > 0, F.struct(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")))
    linked = written(linked.select(node.alias("id"), parent.alias("parent"), *key, "n_convs", "chars"), "linked")
    children = linked.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    known = written(linked.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "tree")
    totals = subtree_totals(known.select("id", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    ends = rows.join(conversations, "conv_id").filter("depth = turns").select(*key, "conv_id")
    ends = ends.unionByName(conversations.filter("turns = 0").select(F.lit(0).cast("long").alias("depth"), zero.alias("s1"), zero.alias("s2"), "conv_id"))
    whole = known.join(totals, "id").join(list_digests(ends, key), key, "left")
    return whole.select("id.conv_id", "id.depth", F.col("parent.conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op11_tree_contraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations, with its members, children, leaves, savings and ends."""
    turns = written(ordered_turns(table(spark, sf_dir, "conversations")), "turns")
    return trie(*rebuilt(turns))


#: crc32 of a decimal number, bit by bit.
_CRC = "xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, x: list_reduce(range(8), lambda a, b: xor(a >> 1, 3988292384 * (a & 1)), xor(c, x)), CAST(4294967295 AS BIGINT)), 4294967295)"
OP11_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS nth FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC} % 6 AS h, max(nth) AS own FROM t GROUP BY 1),
size AS (SELECT i.conv_id, i.base, i.h, i.own, least(i.h, coalesce(b.own, 0)) AS taken FROM ids i LEFT JOIN ids b ON b.conv_id = i.base),
r AS (SELECT s.conv_id, t.nth AS d, t.role, t.text FROM size s JOIN t ON t.conv_id = s.base AND t.nth <= s.h
  UNION ALL SELECT s.conv_id, t.nth - s.h + s.taken, t.role, t.text FROM size s JOIN t ON t.conv_id = s.conv_id AND t.nth > s.h),
path AS (SELECT conv_id, 0 AS d, [] AS p, '' AS text FROM size UNION ALL SELECT conv_id, d, list({{'r': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING), text FROM r),
last AS (SELECT conv_id, max(d) AS m FROM path GROUP BY 1),
named AS (SELECT conv_id AS c, d, text, min(conv_id) OVER (PARTITION BY d, p) AS node FROM path),
n AS (SELECT node, d, count(*) AS n_convs, max(length(text)) AS chars, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (m = d), '') AS ends FROM named JOIN last ON last.conv_id = c GROUP BY 1, 2),
up AS (SELECT n.*, a.node AS parent FROM n LEFT JOIN named a ON a.c = n.node AND a.d = n.d - 1),
kids AS (SELECT parent, d - 1 AS d, count(*) AS k FROM up WHERE parent IS NOT NULL GROUP BY 1, 2),
full_ AS (SELECT up.*, coalesce(k, 0) AS k FROM up LEFT JOIN kids ON kids.parent = up.node AND kids.d = up.d),
sums AS (SELECT a.node, a.d, count(*) FILTER (f.k = 0) AS n_leaves, CAST(sum((f.n_convs - 1) * f.chars) AS BIGINT) AS saved FROM full_ f JOIN named a ON a.c = f.node AND a.d <= f.d GROUP BY 1, 2)
SELECT f.node AS conv_id, CAST(f.d AS BIGINT) AS depth, f.parent AS parent_conv_id, f.n_convs, f.k AS n_children, s.n_leaves, s.saved AS saved_tokens, sha256(f.ends) AS ends_sha256 FROM full_ f JOIN sums s ON s.node = f.node AND s.d = f.d"""

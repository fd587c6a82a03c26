"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is a stream of words: its documents in a hashed order, cut into blocks of equal length and repeated as often
as its target asks, at most three times. The schedule has one slot for each block that the mix takes. Golden-ratio points
mapped through the sources' cumulative targets say which source owns a slot; slots are ranked within their source, and slot
r of a source is joined to block r (modulo the blocks it has). Points beyond a source's quota are void, and slots that the
points left open come last, so that each source gives its target to the word.

Defined cases: a null text has no words; a null source is a source of its own, ordered last; rows with the same doc_id each
count by themselves (ties in the hashed order are broken by the text); an empty table gives an empty result; where no
document has a word, every target is 0; a very long text counts by its words in the JVM and lies in as many blocks as it fills; columns besides doc_id, text and source are ignored. Everything is made of DataFrame
functions. Running sums over a source go through hash ranges of its documents, so a source that holds most rows is spread
over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import n_words, numbered, table, written

#: Words of a block.
BLOCK = 1024
#: No source gives more than this many times its size.
MOST_EPOCHS = 3
#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: Rows of a hash range of one source.
RANGE_ROWS = 2_000
#: Cells into which the unit interval is cut to find a point's source by an equality join.
CELLS = 4_096
GOLDEN = 0.6180339887498949
#: Sources whose targets are broadcast at most, one short row each; beyond, the joins by source shuffle.
BROADCAST_ROWS = 100_000
NULL_SOURCE = "\U0010ffff(null)"


def source_targets(sizes: DataFrame) -> DataFrame:
    """source_key, source_size, weight, target for sizes (source_key, source_size), one row a source.

    The targets are min(cap, level * weight) with the one level at which they add up to all words: what reaching a cap cuts off is
    shared out among the others by weight until none is above. In order of cap / weight, a source is capped while the level
    that those before it leave is still above its own ratio.
    """
    # one row for each source: an aggregate of all rows, which fits one task
    everything = Window.partitionBy(F.lit(1))
    ranked = sizes.withColumns({"_rank": F.row_number().over(everything.orderBy("source_key")), "_all": F.sum("source_size").over(everything)})
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("_rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("_cap", (MOST_EPOCHS * F.col("source_size")).cast("double")).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    before = everything.orderBy("_ratio", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    after = everything.orderBy("_ratio", "source_key").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("_level", level).withColumn("_capped", F.col("_level") >= F.col("_ratio"))
    ranked = ranked.withColumn("_final", F.max(F.when(~F.col("_capped"), F.struct(-F.col("_ratio"), "_level"))).over(everything)["_level"])
    target = F.when(F.col("_capped") | F.col("_final").isNull(), F.col("_cap")).otherwise(F.col("_final") * F.col("weight"))
    return ranked.select("source_key", "source_size", "weight", F.when(F.col("_all") == 0, 0.0).otherwise(target).alias("target"))


def stream(docs: DataFrame, seed: int) -> DataFrame:
    """docs (source_key, order columns, size) with at: the words before a document in its source's hashed order."""
    parts = max(1, docs.count() // RANGE_ROWS)
    h = F.xxhash64(F.lit(seed), "doc_id", "text_hash")
    hashed = docs.withColumn("_h", h).withColumn("_range", F.floor((F.col("_h").cast("double") / 2.0**64 + 0.5) * parts).cast("long"))
    sums = hashed.groupBy("source_key", "_range").agg(F.sum("size").alias("_sum"))
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(Window.partitionBy("source_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    within = Window.partitionBy("source_key", "_range").orderBy("_h", "doc_id", "text_hash", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    inner = hashed.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return inner.join(starts, ["source_key", "_range"]).withColumn("at", F.col("_start") + F.col("_in")).drop("_h", "_range", "_start", "_in")


def _slots(words: Column, size: Column, block: int) -> Column:
    """Blocks that hold so many words of the repeated stream; an epoch's last block may be short."""
    epochs = F.floor(words / size)
    return (epochs * F.ceil(size / block) + F.ceil((words - epochs * size) / block)).cast("long")


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """position, source_key, rank of every slot: the points' slots in order of the points, then those left open."""
    spark = targets.sparkSession
    quota = targets.withColumn("words", F.round("target").cast("long")).filter("words > 0").withColumn("slots", _slots(F.col("words"), F.col("source_size"), block))
    everything = Window.partitionBy(F.lit(1)).orderBy("source_key")
    spans = quota.withColumns({"_up": F.sum("slots").over(everything), "_all": F.sum("slots").over(Window.partitionBy(F.lit(1)))})
    spans = spans.select("source_key", "slots", ((F.col("_up") - F.col("slots")) / F.col("_all")).alias("lo"), (F.col("_up") / F.col("_all")).alias("hi"))
    total = quota.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).first().n
    points = spark.range(total).select(F.col("id").alias("position"), F.expr(f"pmod((id + 1) * {GOLDEN}D, 1D)").alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS).cast("int"), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)).cast("int"))))
    hit = points.join(cells, "cell").filter("u >= lo and u < hi")
    # a running count over a source, through ranges of positions as in stream()
    hit = hit.withColumn("_range", F.floor(F.col("position") / RANGE_ROWS).cast("long"))
    sums = hit.groupBy("source_key", "_range").agg(F.count("*").alias("_n"))
    sums = sums.withColumn("_start", F.coalesce(F.sum("_n").over(Window.partitionBy("source_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    have = sums.groupBy("source_key").agg(F.sum("_n").alias("have"))
    ranked = hit.withColumn("_in", F.row_number().over(Window.partitionBy("source_key", "_range").orderBy("position")))
    ranked = ranked.join(sums.drop("_n"), ["source_key", "_range"]).withColumn("rank", F.col("_start") + F.col("_in") - 1).filter("rank < slots").select("position", "source_key", "rank")
    left = quota.join(have, "source_key", "left").withColumn("have", F.coalesce("have", F.lit(0))).filter("have < slots")
    left = left.select("source_key", F.explode(F.sequence(F.col("have"), F.col("slots") - 1)).alias("rank"))
    left = left.select((F.lit(total) + F.col("rank")).alias("position"), "source_key", "rank")
    return ranked.unionByName(left)


def mix(docs: DataFrame, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """doc_id, row_id, size, source_size, target, taken of every row of docs (doc_id, text, source, row_id)."""
    # keys of our own: a source named like the null's key still differs from it
    key = F.when(F.col("source").isNull(), F.lit(NULL_SOURCE)).otherwise(F.concat(F.lit("s"), F.col("source")))
    sized = docs.select("doc_id", "row_id", key.alias("source_key"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    sized = written(sized, "mix-sizes")  # the texts are read once
    targets = written(source_targets(sized.groupBy("source_key").agg(F.sum("size").alias("source_size"))), "mix-targets")
    side = F.broadcast if targets.count() <= BROADCAST_ROWS else lambda df: df
    placed = stream(sized, seed)
    full = targets.filter("source_size > 0").withColumn("words", F.round("target").cast("long")).select("source_key", "source_size", "words")
    slots = schedule(targets, block).join(side(full), "source_key")
    per_epoch = F.ceil(F.col("source_size") / block).cast("long")
    # a slot is block rank % blocks of one epoch; an epoch's last block is short, and what is over the words of the target is left
    slots = slots.withColumns({"block": F.pmod("rank", per_epoch).cast("long"), "epoch": F.floor(F.col("rank") / per_epoch)})
    lo = F.col("block") * block
    base = F.col("epoch") * F.col("source_size")
    slots = slots.select("source_key", "block", lo.alias("lo"), F.least(lo + block, F.col("source_size"), F.col("words") - base).alias("hi")).filter("hi > lo")
    spans = placed.filter("size > 0").select("doc_id", "row_id", "source_key", "at", (F.col("at") + F.col("size")).alias("to"))
    spans = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("to") - 1) / block))))
    used = spans.join(slots, ["source_key", "block"]).select("row_id", F.greatest(F.lit(0), F.least("to", "hi") - F.greatest("at", "lo")).alias("words"))
    taken = used.groupBy("row_id").agg(F.sum("words").alias("taken"))
    rows = sized.join(side(targets.select("source_key", "source_size", "target")), "source_key").join(taken, "row_id", "left")
    return rows.select("doc_id", "row_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def repeated(docs: DataFrame, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """The mix as whole documents: each row of docs as often as the schedule takes it, to the nearest whole number.

    A document of no words is in no block; it has nothing to add to any source and stays as it is.
    """
    rows = numbered(docs)
    taken = mix(rows.select("doc.doc_id", "doc.text", "doc.source", F.col("row").alias("row_id")), seed, block)
    times = taken.select(F.col("row_id").alias("row"), F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.col("size"))).cast("int").alias("times")).filter("times > 0")
    return rows.join(times, "row").select("doc", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("doc.*")


def op1_golden_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document, with its source's size and target."""
    rows = numbered(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mix(rows.select("doc.*", F.col("row").alias("row_id"))).select("doc_id", "size", "source_size", "target", "taken")

"""Benchmark decontamination: windows of test items as a broadcast hash set, met by every token window of the training documents.

Words are runs of letters, digits and everything beyond ASCII, A-Z lowered. A window is WINDOW consecutive words of an item, or the whole of an
item with fewer. Each document's windows of those lengths are hashed from the hashes of their words, rows of a window are met by the
broadcast set, and what meets is verified word by word in the same pass, so a document's words never leave the task that reads them.
The set goes in blocks of at most MOST_WINDOWS distinct windows, counted first: a larger benchmark takes one scan a block. Hits, which
are few, are shuffled by document and merged into spans with ordered windows, so a document is never gathered. Items that share
windows are known by sets: each document carries names of sets, and each distinct collection of names is resolved into items once.

Defined cases: a null or empty text, or one without words, has no words, hits or items; an item without words has no window; an item
without an id makes words hit, but isn't listed among the items; repeated rows of either table count like others (each document row gives a
row, an item_id is listed once); texts of any length are scanned whole; empty tables give no rows, or rows without hits; other columns
are kept out of the way in a struct.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import numbered, table, written

WINDOW = 10
#: Windows of a broadcast: about 60 MB with their words.
MOST_WINDOWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words once A-Z are lowered, and the same words in the text as it is.
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(PATTERN), F.lit(0))


def hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (key, n, grams, bunch), and the items of each bunch (bunch, items), both as tables."""
    words = items.select(F.col("item_id").cast("string").alias("item"), item_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - window + 1))
    grams = words.select("item", "words", F.explode(starts).alias("at")).select("item", F.slice("words", F.col("at"), window).alias("grams"))
    held = grams.groupBy("grams").agg(F.sort_array(F.collect_set("item")).alias("items"))
    held = written(held.select(F.xxhash64(hashes(F.col("grams"))).alias("key"), F.size("grams").alias("n"), "grams", "items", F.sha2(F.array_join("items", ","), 256).alias("bunch")), "windows")
    return held.drop("items"), written(held.groupBy("bunch").agg(F.first("items").alias("items")), "bunches")


def hits(docs: DataFrame, windows: DataFrame, most: int = MOST_WINDOWS) -> DataFrame:
    """row, at (from 0), n, bunch: every window of a document (row, words) that is a window of the benchmark, word by word."""
    lengths = sorted(r.n for r in windows.select("n").distinct().collect())  # at most WINDOW of them
    blocks = max(1, math.ceil(windows.count() / most))
    if not lengths:
        return docs.select("row", F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit("").alias("bunch")).limit(0)
    sized = docs.select("row", "words", hashes(F.col("words")).alias("h"), F.explode(F.array(*map(F.lit, lengths))).alias("n")).filter("size(words) >= n")
    keys = F.transform(F.sequence(F.lit(1), F.size("h") - F.col("n") + 1), lambda i: F.xxhash64(F.slice("h", i, F.col("n"))))
    scanned = sized.select("row", "words", "n", F.posexplode(keys).alias("at", "key"))

    def met(block: DataFrame) -> DataFrame:
        b = F.broadcast(block).alias("b")
        same = (F.col("a.key") == F.col("b.key")) & (F.col("a.n") == F.col("b.n")) & (F.slice("a.words", F.col("a.at") + 1, F.col("a.n")) == F.col("b.grams"))
        return scanned.alias("a").join(b, same).select("a.row", "a.at", "a.n", "b.bunch")

    return reduce(DataFrame.unionByName, (met(windows.filter(F.pmod(F.col("key"), F.lit(blocks)) == k)) for k in range(blocks)))


def merged(found: DataFrame) -> DataFrame:
    """row, at, n, bunch, reach: hits beside the end of all earlier ones of the document, in order of their places."""
    before = Window.partitionBy("row").orderBy("at", "n").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("reach", F.coalesce(F.max(F.col("at") + F.col("n")).over(before), F.lit(0)))


def spans(found: DataFrame) -> DataFrame:
    """row, spans: disjoint stretches of hit words of each document with hits, as (start, end) from 0, end not included."""
    order = Window.partitionBy("row").orderBy("at", "n")
    islands = merged(found).withColumn("island", F.sum((F.col("at") > F.col("reach")).cast("int")).over(order))
    each = islands.groupBy("row", "island").agg(F.min("at").alias("start"), F.max(F.col("at") + F.col("n")).alias("end"))
    return each.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def listed_items(sets: DataFrame, bunches: DataFrame) -> DataFrame:
    """names, n_items, items_sha256 of each distinct collection of bunch names."""
    names = sets.select("names").distinct()
    each = names.select("names", F.explode("names").alias("bunch")).join(bunches, "bunch").select("names", F.explode("items").alias("item")).distinct()
    return each.groupBy("names").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc (a struct of all columns), n_words, n_hit, n_items, items_sha256, contaminated for every row of docs."""
    rows = numbered(docs)
    windows, bunches = benchmark_windows(items)
    words = item_words(F.col("doc.text"))
    found = merged(hits(rows.select("row", words.alias("words")), windows))
    gain = F.greatest(F.lit(0), F.col("at") + F.col("n") - F.greatest("at", "reach"))
    sets = written(found.groupBy("row").agg(F.sum(gain).cast("long").alias("n_hit"), F.sort_array(F.collect_set("bunch")).alias("names")), "hits")
    sets = sets.join(listed_items(sets, bunches), "names", "left").drop("names")
    whole = rows.select("row", "doc", F.size(words).cast("long").alias("n_words")).join(sets, "row", "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return whole.select("doc", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame, mode: str = "documents") -> DataFrame:
    """docs without contaminated documents, or (mode "spans") with the hit words taken out of their texts.

    What stands between two hit words goes with them; all else of the text stays as it is.
    """
    if mode not in ("documents", "spans"):
        raise ValueError("mode is documents or spans")
    rows = numbered(docs)
    windows, _ = benchmark_windows(items)
    found = hits(rows.select("row", item_words(F.col("doc.text")).alias("words")), windows)
    if mode == "documents":
        return rows.join(found.select("row").distinct(), "row", "left_anti").select("doc.*")
    text = F.col("doc.text")
    raw, gaps = F.regexp_extract_all(text, F.lit(RAW_PATTERN), F.lit(0)), F.split(text, RAW_PATTERN, -1)
    inside = lambda i: F.exists("spans", lambda s: (s["start"] <= i) & (i < s["end"]))
    pieces = F.transform(F.sequence(F.lit(0), F.size("raw") - 1), lambda i: F.when(~inside(i), F.concat(F.element_at("gaps", i + 1), F.element_at("raw", i + 1))).when(inside(i - 1), F.lit("")).otherwise(F.element_at("gaps", i + 1)))
    cut = rows.join(spans(found), "row", "left").withColumns({"raw": F.when(F.col("spans").isNotNull(), raw), "gaps": F.when(F.col("spans").isNotNull(), gaps)})
    left = F.concat(F.array_join(pieces, ""), F.element_at("gaps", -1))
    return cut.select(F.col("doc").withField("text", F.when(F.col("spans").isNull(), text).otherwise(left)).alias("doc")).select("doc.*")


def op12_ngram_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and items of every document against the whole benchmark."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PATTERN}')"
OP12_SQL = f"""
WITH w AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item, n, ws[i + 1 : i + n] AS g FROM (SELECT item, ws, least({WINDOW}, len(ws)) AS n, unnest(range(greatest(len(ws) - {WINDOW - 1}, 1))) AS i FROM w WHERE len(ws) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
grams AS (SELECT r, n, p, ws[p + 1 : p + n] AS g FROM (SELECT r, ws, n, unnest(range(len(ws) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)),
hit AS (SELECT r, p, n, item FROM grams JOIN win USING (n, g)),
covered AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY 1),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)"""

"""Document fingerprints: a canonical exact digest.

A text is brought to one canonical form (compatibility decomposition, case folding, white space folding), hashed to
128 bits with two xxHash64 of different start, and grouped by that hash. Inside a group of equal hashes the canonical
texts themselves are compared; where they differ, the fingerprint gets the SHA-256 of its canonical text as a suffix,
so equal fingerprints always mean equal canonical texts.

Defined cases: a null text counts as the empty text; documents with a null doc_id come last in descending order; rows
with the same doc_id are ordered by their text; an empty table gives an empty result; columns besides doc_id and text are
ignored. Everything is made of DataFrame functions.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import hex64, id_bounds, range_of, table, written

#: A start for the second half of the wide hash.
SECOND_SEED = "second half"

#: Repeated hashes that are broadcast at most.
BROADCAST_ROWS = 500_000

HANGUL = "가-힣"


def _folded(char: str) -> str:
    last = char
    for _ in range(4):
        new = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", last).casefold())
        if new == last:
            break
        last = new
    return last


def _char_class(chars: list[str]) -> str:
    """A regular expression class of the characters, as ranges."""
    codes = sorted(map(ord, chars))
    ranges: list[list[int]] = []
    for c in codes:
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}" + (f"-\\x{{{b:x}}}" if b > a else "") for a, b in ranges) + "]"


@functools.cache
def _tables() -> tuple[dict[str, str], str, dict[str, str], str]:
    """The folding of single characters and their class; combining classes of marks and their class."""
    fold, marks = {}, {}
    for code in range(128, sys.maxunicode + 1):
        c = chr(code)
        if 0xD800 <= code <= 0xDFFF or "가" <= c <= "힣":
            continue
        if (f := _folded(c)) != c:
            fold[c] = f
        if unicodedata.combining(c):
            marks[c] = f"{unicodedata.combining(c):03d}"
    return fold, _char_class([*fold]), marks, _char_class([*marks])


def _literal_map(of: dict[str, str]) -> Column:
    """A map that the optimizer folds to one literal."""
    sep = "\ue000"
    return F.map_from_arrays(*(F.split(F.lit(sep.join(x)), sep) for x in (of.keys(), of.values())))


def _utf16(code: Column) -> Column:
    """The character of a code below 0x10000."""
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 4, "0")), "UTF-16BE")


def _hangul_parts(c: Column) -> Column:
    s = F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("int") - 0xAC00
    tail = s % 28
    return F.concat(_utf16(0x1100 + F.floor(s / 588)), _utf16(0x1161 + F.floor((s % 588) / 28)), F.when(tail > 0, _utf16(0x11A7 + tail)).otherwise(""))


def canonical(text: Column) -> Column:
    """Canonical form of a text: compatibility decomposition with case folding, then single spaces.

    Only the distinct characters of a text that change are looked up, and each is then replaced in the whole text, so that
    a text costs a few passes however long the table is.
    """
    fold, fold_class, marks, mark_class = _tables()
    folds, classes = _literal_map(fold), _literal_map(marks)

    def replaced(t: Column, what: Column, by) -> Column:
        return F.aggregate(what, t, lambda acc, c: F.replace(acc, c, by(c)))

    out = F.lower(F.coalesce(text, F.lit("")))
    out = replaced(out, F.array_distinct(F.regexp_extract_all(out, F.lit(f"[{HANGUL}]"), F.lit(0))), _hangul_parts)

    def foldable(t: Column) -> Column:  # the large class only meets a text's few distinct characters
        return F.filter(F.array_distinct(F.regexp_extract_all(t, F.lit(r"[^\x00-\x7F]"), F.lit(0))), lambda c: F.rlike(c, F.lit(fold_class)))

    out = _let(out, lambda t: replaced(t, foldable(t), lambda c: F.element_at(folds, c)))

    def ordered(run: Column) -> Column:
        parts = F.transform(F.split(run, ""), lambda c, i: F.struct(F.element_at(classes, c).alias("k"), i.alias("i"), c.alias("c")))
        return F.array_join(F.transform(F.array_sort(F.filter(parts, lambda x: x.c != "")), lambda x: x.c), "")

    def runs(t: Column) -> Column:
        wide = F.array_distinct(F.regexp_extract_all(t, F.lit(r"\p{M}{2,}"), F.lit(0)))
        found = F.array_distinct(F.flatten(F.transform(wide, lambda w: F.regexp_extract_all(w, F.lit(mark_class + "{2,}"), F.lit(0)))))
        return F.transform(F.sort_array(F.transform(found, lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))), asc=False), lambda x: x.r)

    out = _let(out, lambda t: replaced(t, runs(t), ordered))
    return F.trim(F.regexp_replace(out, r"[\s\x{85}\p{Z}]+", " "))


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def wide_hash(canon: Column) -> Column:
    """128 bits as 32 hex digits: two xxHash64 of different start."""
    return F.concat(hex64(F.xxhash64(canon)), hex64(F.xxhash64(F.lit(SECOND_SEED), canon)))


def colliding(docs: DataFrame) -> DataFrame:
    """Hashes under which different canonical texts of docs (text) meet, by comparison of their bytes; mostly none.

    Hashes alone are counted first, so that only texts whose hash occurs twice are compared and shuffled. Copies meet in the
    map-side aggregate already: a hash with many copies sends one text from each task. The repeated hashes are broadcast up
    to BROADCAST_ROWS of them (under 64 MB); beyond, the join shuffles.
    """
    hashed = docs.select(canonical(F.col("text")).alias("canon")).withColumn("fp", wide_hash(F.col("canon")))
    twice = written(hashed.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("fp").alias("twice")), "repeated-hashes")
    side = F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice
    met = hashed.join(side, F.col("fp") == F.col("twice"), "left_semi")
    return met.groupBy("fp").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi")).filter(F.col("lo") != F.col("hi")).select("fp")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and canonical text of each row of docs (doc_id, text)."""
    base = docs.select("doc_id", canonical(F.col("text")).alias("canon")).withColumn("fp", wide_hash(F.col("canon")))
    mixed = colliding(docs).withColumn("collides", F.lit(True))
    joined = base.join(mixed, "fp", "left")
    return joined.select("doc_id", F.when(F.col("collides"), F.concat("fp", F.lit("-"), F.sha2("canon", 256))).otherwise(F.col("fp")).alias("fingerprint"), "canon")


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with next_text: the text of the next document in descending order of doc_id, the first one's after the last.

    Documents are dealt into buckets of neighbouring ids, bounded by quantiles of doc_id; a window gives the neighbour inside
    a bucket, and the first row of the next bucket that has rows follows its last one. No task sees the whole order.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    bounds = id_bounds(docs, "doc_id")
    tie = F.xxhash64("text")
    rows = docs.withColumns({"_key": key, "_tie": tie}).withColumn("_bucket", range_of(F.col("_key"), bounds))
    order = [F.desc("_key"), F.col("_tie"), F.col("text")]
    first = rows.groupBy("_bucket").agg(F.min_by(F.struct("text"), F.struct((-(F.col("_key") + 1)).alias("a"), F.col("_tie").alias("b"), F.col("text").alias("c"))).alias("_head"))
    # buckets are few (common.MOST_BUCKETS at most), so that their order fits one task
    heads = first.withColumns({"_after": F.lead("_head").over(Window.orderBy(F.desc("_bucket"))), "_top": F.first("_head").over(Window.orderBy(F.desc("_bucket")))})
    heads = heads.select("_bucket", F.coalesce("_after", "_top").alias("_after"))
    own = rows.withColumn("_lead", F.lead(F.struct("text")).over(Window.partitionBy("_bucket").orderBy(*order)))
    inside = own.withColumn("_last", F.col("_lead").isNull())
    joined = inside.join(heads, "_bucket", "left")
    return joined.withColumn("next_text", F.when(F.col("_last"), F.col("_after.text")).otherwise(F.col("_lead.text"))).drop("_key", "_tie", "_bucket", "_lead", "_last", "_after")


def op9_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with likenesses (1 for equal canonical texts, else 0)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    mixed = colliding(docs).withColumn("collides", F.lit(True))
    n = F.char_length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    pairs = with_next(docs).withColumn("n_chars", n)
    pairs = pairs.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n.cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    pairs = pairs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), canonical(F.col("text")).alias("canon"), canonical(F.col("edited")).alias("edited_canon"), canonical(F.col("next_text")).alias("next_canon"))
    pairs = pairs.select(
        "doc_id", "n_chars", "edited_sha256", wide_hash(F.col("canon")).alias("fp"), F.sha2("canon", 256).alias("sha"), wide_hash(F.col("edited_canon")).alias("edited_fp"),
        (F.col("canon") == F.col("edited_canon")).cast("double").alias("near_edited"), (F.col("canon") == F.col("next_canon")).cast("double").alias("near_next"),
    )
    joined = pairs.join(mixed, "fp", "left")
    return joined.select("doc_id", "n_chars", "edited_sha256", F.when(F.col("collides"), F.concat("fp", F.lit("-"), "sha")).otherwise(F.col("fp")).alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next")

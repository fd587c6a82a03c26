"""Text preparation: normalisation, sections, chunks, sentences."""

from __future__ import annotations

import unicodedata
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.config import SETTINGS

#: Characters that normalisation drops: controls but tab and line feed, and those without width.
DROPPED = r"[\x00-\x08\x0B-\x1F\x7F-\x9F​-‍⁠﻿]"
HEADING = r"^#{1,6}\s+\S"
LEVELS = 6
#: Spoken-sentence rules: abbreviations that don't end a sentence, shortest piece that stands alone.
ABBREVIATIONS = ("dr", "dra", "sr", "sra", "srta", "ud", "uds", "av", "etc", "prof", "lic", "ing", "no", "núm", "tel", "aprox")
SHORTEST_PIECE = 12


def nfkc(text: Column) -> Column:
    """Compatibility composition. Spark has none: rows of plain ASCII never reach the Arrow UDF."""

    @F.pandas_udf("string")
    def composed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return F.when(F.rlike(text, F.lit(r"[^\x09\x0A\x0D\x20-\x7E]")), composed(text)).otherwise(text)


def normalised(text: Column) -> Column:
    """Compatibility composition (NFKC), LF line ends, no control or zero-width characters."""
    return F.regexp_replace(F.regexp_replace(nfkc(text), r"\r\n?", "\n"), DROPPED, "")


def text_layer_reason(text: Column, pages: Column, plain: Column) -> Column:
    """Why a document has too little text, or null: 200 characters and 120 a page, for plain text one."""
    n = F.length(F.trim(text))
    return F.when(n == 0, "empty").when(~plain & (n < F.greatest(F.lit(200), 120 * pages)), "no text layer")


def heading_count(markdown: Column) -> Column:
    return F.regexp_count(markdown, F.lit(r"(?m)" + HEADING))


def sections(docs: DataFrame) -> DataFrame:
    """document_id, section, heading, level, body of docs (document_id, markdown).

    heading is the path of titles from the outermost; text before the first heading has none; empty bodies are left out. A
    title of each level holds until a heading of its own level or a shallower one.
    """
    lines = docs.select("document_id", F.posexplode(F.split("markdown", "\n")).alias("pos", "line"))
    lines = lines.withColumn("level", F.when(F.rlike("line", F.lit(HEADING)), F.length(F.regexp_extract("line", "^(#{1,6})", 1))))
    w = Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("section", F.count("level").over(w))
    title = F.trim(F.regexp_replace("line", r"^#{1,6}\s+", ""))
    parts = []
    for level in range(1, LEVELS + 1):
        own = F.last(F.when(F.col("level") == level, F.struct(F.col("pos").alias("p"), title.alias("t"))), ignorenulls=True).over(w)
        shallower = F.coalesce(F.last(F.when(F.col("level") < level, F.col("pos")), ignorenulls=True).over(w), F.lit(-1))
        parts.append(F.when(own["p"] > shallower, own["t"]))
    pathed = marked.withColumn("path", F.when(F.col("section") > 0, F.concat_ws(" › ", *parts)))
    depth = F.max("level")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("level").isNull(), F.struct("pos", "line")))), lambda x: x.line), "\n")
    out = pathed.groupBy("document_id", "section").agg(F.min_by("path", "pos").alias("heading"), depth.alias("level"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"))
    return out.filter("body != ''")


def packed_sentences(text: Column, size: int = SETTINGS.chunk_chars, overlap: int = SETTINGS.overlap_chars) -> Column:
    """Pieces of at most size characters made of whole sentences; each begins with the end of the one before it, from a word on.

    A sentence longer than size stays whole.
    """
    sentences = F.split(text, r"(?<=[.!?:;])\s+")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def tail(piece: Column) -> Column:
        cut = F.substring(piece, F.greatest(F.lit(1), F.length(piece) - overlap + 1), F.lit(overlap))
        return F.when(F.length(piece) <= overlap, F.lit("")).otherwise(F.when(F.instr(cut, " ") > 0, F.regexp_replace(cut, r"^\S*\s+", "")).otherwise(""))

    def add(acc: Column, s: Column) -> Column:
        joined = F.when(acc["open"] == "", s).otherwise(F.concat(acc["open"], F.lit(" "), s))
        kept = tail(acc["open"])
        fresh = F.when((kept == "") | (F.length(kept) + 1 + F.length(s) > size), s).otherwise(F.concat(kept, F.lit(" "), s))
        fits = (acc["open"] == "") | (F.length(joined) <= size)
        return F.struct(F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])).alias("done"), F.when(fits, joined).otherwise(fresh).alias("open"))

    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.aggregate(sentences, empty, add, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))))


def merged_sections(rows: list[tuple[str | None, str]], short: int = SETTINGS.short_section_chars, strict_kin: bool = True) -> list[tuple[str | None, str]]:
    """(heading path, body) of one document after merging short sections into kin.

    A short section joins the chunk before it when that has its path or its parent's, with its own title kept in the text;
    else it waits and goes before the next section if that lies below it. It never joins a sibling. What waits at the end is a
    chunk of its own, or, without strict_kin, part of the last chunk.
    """
    out: list[list] = []
    waiting: list | None = None

    def path(h: str | None) -> list[str]:
        return h.split(" › ") if h else []

    for heading, body in rows:
        own = path(heading)
        if waiting is not None:
            above = path(waiting[0])
            if len(own) > len(above) and own[: len(above)] == above:
                body = waiting[1] + "\n\n" + body
            else:
                out.append(waiting)
            waiting = None
        if len(body) >= short:
            out.append([heading, body])
            continue
        last = path(out[-1][0]) if out else None
        if last is not None and (own == last or own[:-1] == last) and own:
            out[-1][1] += "\n\n" + (body if own == last else f"{own[-1]}\n{body}")
        else:
            waiting = [heading, body]
    if waiting is not None:
        if strict_kin or not out:
            out.append(waiting)
        else:
            out[-1][1] += "\n\n" + waiting[1]
    return [(h, b) for h, b in out]


def merged(sectioned: DataFrame, strict_kin: bool = True) -> DataFrame:
    """sections() with short ones merged: document_id, part, heading, body. One document is one row here."""
    listed = sectioned.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("section", "heading", "body"))).alias("s"))
    kind = "array<struct<heading:string,body:string>>"

    @F.pandas_udf(kind)
    def merge(docs: pd.Series) -> pd.Series:
        return docs.map(lambda s: [{"heading": h, "body": b} for h, b in merged_sections([(x["heading"], x["body"]) for x in s], strict_kin=strict_kin)])

    return listed.select("document_id", F.posexplode(merge("s")).alias("part", "m")).select("document_id", "part", "m.heading", "m.body")


def chunked(docs: DataFrame, strict_kin: bool = True) -> DataFrame:
    """document_id, ordinal (0-based, dense), heading, content of docs (document_id, markdown)."""
    parts = merged(sections(docs), strict_kin).select("document_id", "part", "heading", F.posexplode(packed_sentences(F.col("body"))).alias("piece", "content"))
    order = Window.partitionBy("document_id").orderBy("part", "piece")
    return parts.select("document_id", (F.row_number().over(order) - 1).cast("long").alias("ordinal"), "heading", "content")


def page_of(offset: Column, page_starts: Column) -> Column:
    return F.size(F.filter(page_starts, lambda s: s <= offset))


def with_pages(chunks: DataFrame, docs: DataFrame, prefix: int = 60) -> DataFrame:
    """chunks with page: found by the first characters from where the last chunk was found, else from the start, else null."""
    listed = chunks.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "content"))).alias("c")).join(docs.select("document_id", "markdown", "page_starts"), "document_id")
    start = F.struct(F.array().cast("array<int>").alias("found"), F.lit(1).alias("cursor"))
    text = F.col("markdown")

    def step(acc: Column, c: Column) -> Column:
        needle = F.substring(c["content"], 1, prefix)
        at = F.position(needle, text, acc["cursor"])
        hit = F.when(at > 0, at).otherwise(F.position(needle, text, F.lit(1)))
        return F.struct(F.array_append(acc["found"], hit).alias("found"), F.when(hit > 0, hit).otherwise(acc["cursor"]).alias("cursor"))

    placed = listed.withColumn("found", F.aggregate("c", start, step, lambda acc: acc["found"]))
    each = placed.select("document_id", "page_starts", F.explode(F.arrays_zip("c", "found")).alias("z"))
    at = F.col("z.found")
    return each.select("document_id", F.col("z.c.ordinal").alias("ordinal"), F.col("z.c.content").alias("content"), F.when(at > 0, page_of(at - 1, F.col("page_starts"))).alias("page"))


def spoken_sentences(text: Column) -> Column:
    """Sentences as they are spoken: cut after . ! ? … before a capital or an opening mark, not after abbreviations or initials;
    pieces shorter than SHORTEST_PIECE take the next one in."""
    cuts = F.split(text, r"(?<=[.!?…])\s+(?=[\p{Lu}¿¡])")
    false_end = r"(?i)(?:^|[\s(])(?:" + "|".join(ABBREVIATIONS) + r")\.$|(?:^|\s)\p{L}\.$"

    def add(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = F.rlike(last, F.lit(false_end)) | (F.length(last) < SHORTEST_PIECE)
        longer = F.array_append(F.slice(acc, 1, F.size(acc) - 1), F.concat(last, F.lit(" "), s))
        return F.when(F.size(acc) == 0, F.array(s)).when(joins, longer).otherwise(F.array_append(acc, s))

    return F.filter(F.aggregate(cuts, F.array().cast("array<string>"), add), lambda s: s != "")


def canonical_title(title: Column) -> Column:
    """NFKC, one kind of dash, lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(nfkc(title), "[‐-―−]", "-")), r"\s+", " "))


def heading_accuracy(extracted: DataFrame, expected: DataFrame) -> DataFrame:
    """found, in_order and level_ok of each expected heading (document_id, pos, title, level) by the extracted ones (the same columns).

    Levels are compared from each side's top, of equal titles the first ones. in_order: the heading is on a longest run of
    found titles that stand in the same order on both sides, by patience sorting of each document's headings.
    """
    by_document = Window.partitionBy("document_id")

    def side(df: DataFrame, depth: str, place: str) -> DataFrame:
        keyed = df.select("document_id", canonical_title(F.col("title")).alias("title"), (F.col("level") - F.min("level").over(by_document)).alias(depth), F.col("pos").alias(place))
        return keyed.withColumn("nth", F.row_number().over(Window.partitionBy("document_id", "title").orderBy(place)))

    got, want = side(extracted, "got", "got_at"), side(expected, "want", "pos")
    first = got.filter("nth = 1").drop("nth")
    joined = want.join(got, ["document_id", "title", "nth"], "left").join(first.select("document_id", "title", F.col("got").alias("first")), ["document_id", "title"], "left")

    @F.pandas_udf("array<long>")
    def ordered(lists: pd.Series) -> pd.Series:
        return lists.map(lambda found: [found[k]["pos"] for k in _rising([x["got_at"] for x in found])])

    listed = joined.filter("got_at is not null").groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), F.col("got_at").cast("long").alias("got_at")))).alias("found"))
    runs = listed.select("document_id", F.explode(ordered("found")).alias("pos"), F.lit(True).alias("kept"))
    out = joined.withColumn("pos", F.col("pos").cast("long")).join(runs, ["document_id", "pos"], "left")
    level_ok = F.coalesce(F.coalesce(F.col("got"), F.col("first")) == F.col("want"), F.lit(False))
    return out.select("document_id", "pos", "title", F.col("first").isNotNull().alias("found"), F.coalesce("kept", F.lit(False)).alias("in_order"), level_ok.alias("level_ok"))


def _rising(values: list[int]) -> list[int]:
    """Places of a longest rising run."""
    ends: list[int] = []  # the place of the least value that ends a run of each length
    before = []
    for i, v in enumerate(values):
        k = bisect_left(ends, v, key=values.__getitem__)
        before.append(ends[k - 1] if k else -1)
        ends[k : k + 1] = [i]
    run, i = [], ends[-1] if ends else -1
    while i >= 0:
        run.append(i)
        i = before[i]
    return run[::-1]

"""Line deduplication by pairwise alignment.

Documents are paired through the hashes of passages: the shortest run of whole lines with MIN_WORDS words or more, from each line
on and up to each line (mostly the line itself; blank lines don't count). What a document loses is what an alignment with any
earlier holder of one of its passages takes. Not every pair has to be aligned for that:

Documents with the same shared passages at the same distances lose the same to others, so the first of them stands for all, and
each of the others, which is aligned with it, loses all that it shares with any document. The rest is done in rounds. In the first, a
document is aligned with the first holder of each of its passages and with the NEAREST earlier ones (a passage of FREQUENT holders
or more: with the first alone). Only lines of shared passages can be lost, so a passage whose lines are all lost needs no more
partners; each other one goes on to its next nearest holders, WIDER times as many in each round, until its lines are lost or it has met
all earlier holders. So no partner is left out that could take a line. A pair is aligned over all passages that both hold.

Each pair is aligned by patience diff over the passages that both hold, in the order of each: equal ones at both ends are
taken, those that occur once on both sides are anchors, of which the longest run in both orders is kept, and the same is done
between anchors; where there are none, the ends are all. Neighbours at the same distance on both sides are one block. Lines of
blocks are deleted from the later document. Lines that both hold, but in another order, aren't aligned and stay, unless they
make up a block of MOVED_WORDS or more (a second pass, of moved blocks): a moved passage is a copy, a moved short line is not.

A passage that is repeated in one document alone stays.

Defined cases: a null text stays null, an empty one empty, and neither has lines; lines without a word pair nothing and stay;
rows with the same doc_id are ordered by their place in the files, and copies among them lose their lines like others; a null
doc_id comes after all others; an empty table gives an empty result; a very long text is held by a task in whole, with two rows a
line at most, and its common passages are sorted once for each document that it is paired with; other columns are kept, and their names
are no matter, since working columns stand beside a struct of them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import numbered, table, text_batches, written

#: Words of an aligned block that is deleted, of a moved one.
MIN_WORDS, MOVED_WORDS = 5, 15
#: Earlier holders of a passage, besides the first, that a document is aligned with at first, and how many times more in each round after
#: it; holders from which a passage counts as frequent, so that the first alone is met at first; frequent passages that are broadcast at
#: most; pairs whose matches are unpacked at once.
NEAREST, WIDER, FREQUENT, BROADCAST_ROWS, UNPACKED = 3, 4, 64, 200_000, 16
#: occ: the passage's places in the document, each with the positions among all lines, and the words, of its lines.
PASSAGES = "row long, doc_id long, h1 long, h2 long, occ array<struct<at:int,pos:array<int>,words:array<int>>>"
#: A line that a document loses, and the place of the earlier document that it was aligned with.
LINES = "row long, at int, pos int, words int, e struct<last:boolean,id:long,row:long>"
LOST = "row long, removed array<boolean>, n_removed int, words_removed long, earlier array<long>"


def word_lines(text: str | None) -> list[tuple[int, int, bytes]]:
    """Lines with a word: position among all lines, number of words, the line without white space around it."""
    return [(pos, n, line.strip()) for pos, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")) if (n := len(line.split()))]


def passages(lines: list[tuple[int, int, bytes]], least: int = MIN_WORDS) -> Iterator[tuple[int, int]]:
    """First line and number of lines of the shortest runs of so many words, from each line on and up to each line, once each."""
    before, found = np.cumsum([0, *(n for _, n, _ in lines)]), set()
    for i in range(len(lines)):
        j = bisect_left(before, before[i] + least, i + 1)  # from i on
        if j < len(before) and (i, j) not in found:
            found.add((i, j))
            yield i, j - i
        k = bisect_left(before, before[i + 1] - least + 1, 0, i + 2) - 1  # up to i
        if k >= 0 and (k, i + 1) not in found:
            found.add((k, i + 1))
            yield k, i + 1 - k


def passage_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PASSAGES rows of (row, doc_id, text): one for each different passage of a document."""
    for b in batches:
        rows: list[tuple] = []
        for row, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
            lines, occ = word_lines(text), defaultdict(list)
            for at, n in passages(lines):
                h = xxhash.xxh3_128_intdigest(lines[at][2] if n == 1 else b"\n".join(x[2] for x in lines[at : at + n]))
                occ[h].append({"at": at, "pos": [x[0] for x in lines[at : at + n]], "words": [x[1] for x in lines[at : at + n]]})
            for h, places in occ.items():
                rows.append((row, doc_id, h >> 64, h & 0xFFFFFFFFFFFFFFFF, places))
                if len(rows) == 20_000:
                    yield _batch(rows)
                    rows = []
        yield _batch(rows)


PLACE = pa.struct([("at", pa.int32()), ("pos", pa.list_(pa.int32())), ("words", pa.list_(pa.int32()))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    row, doc_id, h1, h2, occ = zip(*rows, strict=True) if rows else ((),) * 5
    hashes = [pa.array(np.array(h, np.uint64).view(np.int64)) for h in (h1, h2)]
    return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(doc_id, pa.int64()), *hashes, pa.array(occ, pa.list_(PLACE))], ["row", "doc_id", "h1", "h2", "occ"])


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing run, by patience sorting."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before[i] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b) of two sequences, rising in both."""
    out, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        i, i_end, j, j_end = gaps.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        n_a, n_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        where = {x: k for k, x in enumerate(b[j:j_end], j) if n_b[x] == 1}
        single = [(k, where[x]) for k, x in enumerate(a[i:i_end], i) if n_a[x] == 1 and x in where]
        anchors = [single[k] for k in increasing([k for _, k in single])]
        out += anchors
        if anchors:
            for (p, q), (p_end, q_end) in zip([(i - 1, j - 1), *anchors], [*anchors, (i_end, j_end)], strict=True):
                gaps.append((p + 1, p_end, q + 1, q_end))
    return sorted(out)


Line = tuple[int, int]  # position among all lines, words


def blocks(pairs: list[tuple[int, int, list[Line]]]) -> Iterator[dict[int, Line]]:
    """Runs of pairs (later line, earlier line, lines) at the same distance on both sides, as later line -> Line."""
    block: dict[int, Line] = {}
    offset = end = None
    for at, e_at, lines in pairs:
        if block and (at - e_at != offset or at > end):
            yield block
            block, end = {}, None
        offset, end = at - e_at, max(end or 0, at + len(lines))
        block.update(enumerate(lines, at))
    if block:
        yield block


def common_lines(matches: list[tuple[list[tuple[int, list[Line]]], list[int]]]) -> dict[int, Line]:
    """Lines that a document loses to an earlier one, from their common passages: each a list of places (line, its lines) in the
    later document and a sorted list of lines in the earlier one."""
    a = sorted((at, len(lines), k, lines) for k, (places, _) in enumerate(matches) for at, lines in places)
    b = sorted((e_at, len(matches[k][0][0][1]), k) for k, (_, earlier) in enumerate(matches) for e_at in earlier)
    found = patience([x[2] for x in a], [x[2] for x in b])
    gone: dict[int, Line] = {}
    for block in blocks([(a[i][0], b[j][0], a[i][3]) for i, j in found]):
        gone.update(block)
    taken = {i for i, _ in found}
    moved, offset = [], None
    for i, (at, _, k, lines) in enumerate(a):
        if i not in taken and not all(x in gone for x in range(at, at + len(lines))):
            earlier = matches[k][1]
            want = earlier[0] if offset is None else at - offset
            p = bisect_left(earlier, want)
            e_at = want if p < len(earlier) and earlier[p] == want else earlier[0]
            moved.append((at, e_at, lines))
            offset = at - e_at
    for block in blocks(moved):
        if sum(n for _, n in block.values()) >= MOVED_WORDS:
            gone.update(block)
    return gone


def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """LINES rows of pairs (row, e: the earlier document's place, found: all passages that both hold, with their lines in the earlier one)."""
    for whole in batches:
        for lo in range(0, whole.num_rows, UNPACKED):
            out = []
            for pair in whole.slice(lo, UNPACKED).to_pylist():
                matches = [([(o["at"], list(zip(o["pos"], o["words"], strict=True))) for o in m["occ"]], sorted(m["e_ats"])) for m in pair["found"]]
                out += [(pair["row"], at, pos, words, pair["e"]) for at, (pos, words) in common_lines(matches).items()]
            row, at, pos, words, e = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(row, pa.int64()), *(pa.array(x, pa.int32()) for x in (at, pos, words)), pa.array(e, pa.struct([("last", pa.bool_()), ("id", pa.int64()), ("row", pa.int64())]))],
                ["row", "at", "pos", "words", "e"],
            )


def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """LOST rows of (row, pos, n_removed, words_removed, earlier), pos as a mask of all lines up to the last one."""
    for b in batches:
        removed = []
        for pos in b.column("pos").to_pylist():
            mask = np.zeros(max(pos) + 1, bool)
            mask[pos] = True
            removed.append(mask)
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(removed, pa.list_(pa.bool_())), *(b.column(c) for c in ("n_removed", "words_removed", "earlier"))], [x.split()[0] for x in LOST.split(", ")])


def in_order(rows: DataFrame, *by: str) -> DataFrame:
    """rows with g, their place in that order without gaps; a frequent value goes through as many tasks as others."""
    placed = numbered(written(rows.orderBy(*by), "ordered")).select("doc.*", F.shiftright("row", 40).alias("_file"), F.col("row").bitwiseAND((1 << 40) - 1).alias("_n"))
    counts, starts, at = placed.groupBy("_file").count().sort("_file").collect(), [], 0
    for file, n in counts:
        starts.append((file, at))
        at += n
    starts = rows.sparkSession.createDataFrame(starts, "_file long, _at long")
    return placed.join(F.broadcast(starts), "_file").select(*rows.columns, (F.col("_at") + F.col("_n")).alias("g"))


def lines_of_pairs(pairs: DataFrame, own: DataFrame, sizes: DataFrame) -> DataFrame:
    """LINES rows of pairs (row, e): all passages that both hold, found from the one with fewer passages, and aligned."""
    both = pairs.join(sizes, "row").join(sizes.select(F.col("row").alias("e_row"), F.col("n").alias("e_n")), F.col("e.row") == F.col("e_row"))
    later = F.col("n") <= F.col("e_n")
    both = both.select(F.col("row").alias("d"), "e", later.alias("later"), F.when(later, F.col("row")).otherwise(F.col("e_row")).alias("row"), F.when(later, F.col("e_row")).otherwise(F.col("row")).alias("other"))
    mine = both.join(own, "row").select("d", "e", "later", F.col("other").alias("row"), "h1", "h2", F.col("occ").alias("mine"))
    met = mine.join(own, ["row", "h1", "h2"])
    occ, theirs = (F.when(F.col("later") == x, F.col("mine")).otherwise(F.col("occ")) for x in (True, False))
    met = met.select(F.col("d").alias("row"), "e", F.struct(occ.alias("occ"), F.transform(theirs, lambda o: o["at"]).alias("e_ats")).alias("m"))
    with text_batches(pairs.sparkSession):
        return written(met.groupBy("row", "e").agg(F.collect_list("m").alias("found")).mapInArrow(aligned, LINES), "pair-lines")


def with_shared_passages(found: DataFrame) -> DataFrame:
    """row, doc_id, found (the passages that other documents hold too) and s1, s2 (a digest of what they are and where) of PASSAGES rows."""
    keys = ["h1", "h2"]
    shared = written(found.groupBy(*keys).agg(F.count("*").alias("holders")).filter("holders > 1"), "shared-passages")
    frequent = shared.filter(F.col("holders") >= FREQUENT).select(*keys)
    if frequent.count() <= BROADCAST_ROWS:
        # rows of frequent passages are known where they are; only the others are shuffled by hash
        others = found.join(F.broadcast(frequent), keys, "left_anti")
        own = found.join(F.broadcast(frequent), keys).unionByName(others.join(shared.filter(F.col("holders") < FREQUENT).select(*keys), keys))
    else:
        own = found.join(shared.select(*keys), keys)
    least = F.min(F.array_min(F.transform("occ", lambda o: o["at"]))).alias("least")
    held = own.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct(*keys, "occ"))).alias("found"), least)
    told = F.transform("found", lambda x: F.struct(x["h1"], x["h2"], F.transform(x["occ"], lambda o: o["at"] - F.col("least"))))
    return written(held.select("row", "doc_id", "found", F.xxhash64(told).alias("s1"), F.xxhash64(F.lit(1), told).alias("s2")), "held-passages")


def deletions(keyed: DataFrame) -> DataFrame:
    """LOST rows for keyed (row, doc_id, text): what each later document loses."""
    spark, keys = keyed.sparkSession, ["h1", "h2"]
    with text_batches(spark):
        found = written(keyed.select("row", "doc_id", "text").mapInArrow(passage_rows, PASSAGES), "passages")
    held = with_shared_passages(found)
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("row").alias("row"))

    # documents that share the same passages at the same distances: the first stands for all, the others are aligned with it alone
    tops = held.groupBy("s1", "s2").agg(F.min(place).alias("e"), F.count("*").alias("members")).filter("members > 1").drop("members")
    copies = written(held.select("row", "s1", "s2").join(tops, ["s1", "s2"]).filter("row != e.row").select("row", "e"), "copies")
    same = F.transform("found", lambda x: F.struct(x["occ"].alias("occ"), F.transform(x["occ"], lambda o: o["at"]).alias("e_ats")))
    with text_batches(spark):
        lost = [written(held.join(copies, "row").select("row", "e", same.alias("found")).mapInArrow(aligned, LINES), "copied-lines")]
    firsts = held.join(copies, "row", "left_anti")
    own = written(firsts.select("row", "doc_id", F.explode("found").alias("x")).select("row", "doc_id", "x.*"), "own-passages")
    sizes = own.groupBy("row").agg(F.count("*").alias("n"))

    # holders of each passage in a row; at first the first holder and the nearest ones
    ranked = in_order(own.select(*keys, place.alias("e")), *keys, "e")
    starts = ranked.groupBy(*keys).agg(F.min(F.struct("g", "e")).alias("first"), F.count("*").alias("holders")).filter("holders > 1")
    ranked = written(ranked.join(starts, keys).select(*keys, "e", "g", F.col("e.row").alias("row"), F.col("first.g").alias("start"), F.col("first.e").alias("first"), "holders"), "ranked-passages")
    open_ = ranked.filter("g > start").select("row", *keys, "g", "start", F.lit(0).alias("done"), F.when(F.col("holders") < FREQUENT, NEAREST).otherwise(0).alias("most"))
    at_g = ranked.select("g", "e")
    pairs = ranked.filter("g > start").select("row", F.col("first").alias("e"))
    tried = None
    most = NEAREST
    while True:
        # holders beyond the first, from the nearest not yet met on; the first has its own pair
        end = F.least(F.col("done") + F.col("most"), F.col("g") - F.col("start") - 1)
        wanted = open_.filter(end > F.col("done")).select("row", F.explode(F.sequence(F.col("done") + 1, end)).alias("k"), "g").select("row", (F.col("g") - F.col("k")).alias("g"))
        near = wanted.join(at_g, "g").select("row", "e")
        pairs = (near if pairs is None else near.unionByName(pairs)).distinct()
        pairs = written(pairs if tried is None else pairs.join(tried.select("row", "e"), ["row", "e"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        lost.append(lines_of_pairs(pairs, own, sizes))
        # a passage whose lines are all lost has nothing more to lose; the others go on to their next holders until there are none
        left = open_.withColumn("done", end).filter(F.col("done") < F.col("g") - F.col("start") - 1).select("row", *keys, "g", "start", "done")
        lines = F.flatten(F.transform("occ", lambda o: F.sequence(o["at"], o["at"] + F.size(o["pos"]) - 1)))
        gone = _union(lost).select("row", "at").distinct()
        stays = left.select("row", *keys).join(own, ["row", *keys]).select("row", *keys, F.explode(lines).alias("at")).join(gone, ["row", "at"], "left_anti").select("row", *keys).distinct()
        most *= WIDER
        open_ = written(left.join(stays, ["row", *keys]).withColumn("most", F.lit(most)), "open-passages")
        if open_.isEmpty():
            break
        pairs = None
    lines = _union(lost).groupBy("row", "at").agg(F.min("pos").alias("pos"), F.min("words").alias("words"), F.min("e").alias("e"))
    by_row = lines.groupBy("row").agg(F.collect_list("pos").alias("pos"), F.count("*").cast("int").alias("n_removed"), F.sum("words").alias("words_removed"), F.sort_array(F.collect_set("e.id")).alias("earlier"))
    with text_batches(spark):
        return written(by_row.mapInArrow(masks, LOST), "lost-lines")


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc (the row of docs), text without the blocks that earlier documents hold, and lost (LOST without row, or null)."""
    rows = numbered(docs)
    lost = deletions(rows.select("row", "doc.doc_id", "doc.text"))
    lost = lost.select("row", F.struct("removed", "n_removed", "words_removed", "earlier").alias("lost"))
    kept = F.array_join(F.filter(F.split("doc.text", "\n"), lambda line, i: ~F.coalesce(F.get(F.col("lost.removed"), i), F.lit(False))), "\n")
    return rows.join(lost, "row", "left").select("doc", F.when(F.col("lost").isNull(), F.col("doc.text")).otherwise(kept).alias("text"), "lost")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated blocks deleted; n_chars, where there is one, follows the new text."""
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return deduplicated(docs).select(*(new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns))


def op7_patience_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text after deletion, with what it lost and the earlier documents that hold it."""
    found = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lost = F.col("lost")
    return found.select("doc.doc_id", F.coalesce(lost["n_removed"], F.lit(0)).cast("long").alias("lines_removed"), F.coalesce(lost["words_removed"], F.lit(0)).cast("long").alias("words_removed"), F.coalesce(lost["earlier"], F.array().cast("array<long>")).alias("earlier_ids"), "text")

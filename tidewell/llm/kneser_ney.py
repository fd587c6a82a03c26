"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of characters.

The model is of order ORDER over the characters of trusted documents (quality 1), four in five of them by hash; the fifth
that it doesn't learn from sets the thresholds: a document is rejected when its perplexity is above MARGIN times the QUANTILE of its
language there. A language without such documents takes the quantile of all.

Work is dealt by blocks: the first PIECE characters of 2**BLOCK_BITS neighbouring rows of an input file are one, which every scan of
the files finds again; the rest of long texts goes by pieces to blocks of twice as many pieces and half as many rows, and so on,
so that no block holds more than 2**BLOCK_BITS * PIECE characters. The first scan sends each block's distinct character n-grams with
their trusted counts to a table bucketed by n-gram. Counts of all orders come from joins and aggregates by n-gram, context and suffix,
sharded by those keys, and so do the probabilities of all n-grams that any block asks for; no task holds the whole model, and what
is sent grows with the blocks. The second scan sends each block's texts compressed to where its n-grams' probabilities have come
together, and sums them by document.

Defined cases: a null text is the empty text, whose perplexity is that of ending at once; a null language is a language of its
own; a language with fewer than SUPPORT documents to calibrate on takes the threshold of all; a document with several labels is
trusted if one says so; a table without trusted documents rejects nothing; rows with the same doc_id are each scored; an empty
table gives an empty result; a very long text is cut by one task and scored piece by piece; other columns are kept by accepted().
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import bucketed, numbered, table, text_batches, written

ORDER = 5
#: One trusted document in so many only calibrates; the quantile of perplexities there, how far beyond it rejection begins, and the
#: documents from which a language has a quantile of its own.
HELD_OUT, QUANTILE, MARGIN, SUPPORT = 5, 0.99, 1.3, 20
#: Rows of a block as a power of two, characters of a piece, characters handled at once, trusted ids that are broadcast at most.
BLOCK_BITS, PIECE, SLICE, BROADCAST_ROWS = 13, 1 << 16, 1 << 19, 2_000_000
START, END = "\x02", "\x03"
PAD = START * (ORDER - 1)
SPACES = re.compile(r"\s+")
BASE = np.uint64(0x9E3779B97F4A7C15)


def block_of(row: int, piece: int) -> int:
    """The block of a row's piece: the first row of a range, with the piece's level in bits that are 0 there."""
    level = piece.bit_length()
    shift = max(5, BLOCK_BITS - max(0, level - 1))
    return row >> shift << shift | level


def cut(rows: pd.DataFrame) -> pd.DataFrame:
    """block, row, piece (and trusted) of rows (row, text): characters between pads and end, ORDER - 1 of which neighbours share."""
    out = []
    for k, (row, text) in enumerate(zip(rows["row"], rows["text"], strict=True)):
        whole = PAD + SPACES.sub(" ", text or "").strip() + END
        out += [(block_of(row, j), row, whole[j * PIECE : (j + 1) * PIECE + ORDER - 1], k) for j in range(max(1, -(-(len(whole) - ORDER + 1) // PIECE)))]
    found = pd.DataFrame(out, columns=["block", "row", "piece", "k"])
    return found.assign(trusted=rows["trusted"].to_numpy(bool)[found["k"].to_numpy(np.int64)]) if "trusted" in rows else found


def characters(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the pieces, and where each begins."""
    codes = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), "<u4")
    return codes, np.cumsum([0, *map(len, pieces)])


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ORDER characters from each place on."""
    n = len(codes) - ORDER + 1
    out = np.zeros(n, np.uint64)
    for k in range(ORDER):
        out = (out + codes[k : k + n].astype(np.uint64) + np.uint64(1)) * BASE
    return out ^ (out >> np.uint64(29))


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE characters."""
    lo, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= SLICE:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _inner(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose n-gram lies within one text, and the text of each."""
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    n = len(codes) - ORDER + 1
    inside = text[:n] == text[ORDER - 1 :]
    return np.flatnonzero(inside), text[:n][inside]


Grams = tuple[np.ndarray, np.ndarray, np.ndarray]


def merged(parts: list[Grams]) -> Grams:
    """Hashes, code points (a row each) and counts of the distinct n-grams of several such triples."""
    number, unique = pd.factorize(np.concatenate([p[0] for p in parts]))
    first = np.flatnonzero(np.diff(np.maximum.accumulate(number), prepend=-1))
    return unique, np.concatenate([p[1] for p in parts])[first], np.bincount(number, np.concatenate([p[2] for p in parts]), len(unique)).astype(np.int64)


def distinct_grams(texts: list[str], trusted: np.ndarray) -> Grams:
    """Distinct n-grams of the texts, with how often each stands in trusted ones."""
    out: list[Grams] = [(np.zeros(0, np.uint64), np.zeros((0, ORDER), "<u4"), np.zeros(0, np.int64))]
    for lo, hi in _slices(texts):
        codes, starts = characters(texts[lo:hi])
        places, text = _inner(codes, starts)
        number, unique = pd.factorize(gram_hashes(codes)[places])
        first = places[np.flatnonzero(np.diff(np.maximum.accumulate(number), prepend=-1))]
        counts = np.bincount(number[trusted[lo:hi][text]], minlength=len(unique))
        out = [merged([*out, (unique, codes[first[:, None] + np.arange(ORDER)], counts)])]
    return out[0]


def _grams(block: int, grams: Grams) -> Iterator[pd.DataFrame]:
    _, codes, counts = grams
    for at in range(0, len(counts), 50_000):
        text = codes[at : at + 50_000].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        yield pd.DataFrame({"block": block, "gram": [text[i : i + ORDER] for i in range(0, len(text), ORDER)], "n": counts[at : at + 50_000]})


def _gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct n-grams of each block in this task; rows come in order, so that one block of each level is held."""
    held: dict[int, tuple[int, Grams]] = {}
    for b in batches:
        for block, rows in cut(b).groupby("block", sort=False):
            new, level = distinct_grams(list(rows["piece"]), rows["trusted"].to_numpy(bool)), block & 31
            if level in held and held[level][0] == block:
                new = merged([held[level][1], new])
            elif level in held:
                yield from _grams(*held[level])
            held[level] = (block, new)
    for block, grams in held.values():
        yield from _grams(block, grams)


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of a block in compressed runs of about SLICE characters, with their row numbers."""
    press = zstandard.ZstdCompressor(level=3)
    for b in batches:
        for block, rows in cut(b).groupby("block", sort=False):
            pieces = list(rows["piece"])
            for lo, hi in _slices(pieces):
                texts = [t.encode("utf-8", "surrogatepass") for t in pieces[lo:hi]]
                yield pd.DataFrame([{"block": block, "ids": list(rows["row"].iloc[lo:hi]), "sizes": [len(t) for t in texts], "packed": press.compress(b"".join(texts))}])


def _score(key: tuple, packed: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Log probability and length of each piece of a block."""
    lookup = np.zeros(0, np.uint64)
    if len(known):
        lookup = gram_hashes(np.frombuffer("".join(known["gram"]).encode("utf-32-le", "surrogatepass"), "<u4"))[::ORDER]
    lookup, first = np.unique(lookup, return_index=True)  # tasks that share a block ask for the same n-grams
    index, logs, undo, out = pd.Index(lookup), known["log_p"].to_numpy(float)[first], zstandard.ZstdDecompressor(), []
    for ids, sizes, blob in zip(packed["ids"], packed["sizes"], packed["packed"], strict=True):
        raw, ends = undo.decompress(blob), np.cumsum([0, *sizes])
        texts = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for lo, hi in _slices(texts):
            codes, starts = characters(texts[lo:hi])
            places, text = _inner(codes, starts)
            at = index.get_indexer(gram_hashes(codes)[places])
            if (at < 0).any():
                raise ValueError("a block's n-grams differ from those it asked for")
            out.append(pd.DataFrame({"row": ids[lo:hi], "log_p": np.bincount(text, logs[at], hi - lo), "n": np.bincount(text, minlength=hi - lo)}))
    return pd.concat(out) if out else pd.DataFrame({"row": [], "log_p": [], "n": []})


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the counts of counts of k."""
    n = counts.filter("k > 0").agg(*(F.count_if(F.col("k") == i).cast("double").alias(f"n{i}") for i in range(1, 5))).first()
    n1, n2, n3, n4 = (max(x or 0.0, 0.0) for x in n)
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1))


def _discounted(k: Column, d: tuple[float, float, float]) -> Column:
    return F.greatest(k - F.when(k == 1, d[0]).when(k == 2, d[1]).when(k >= 3, d[2]).otherwise(0.0), F.lit(0.0))


def probabilities(grams: DataFrame) -> DataFrame:
    """gram, log_p of all grams (gram of ORDER characters, n its trusted count, which may be 0)."""
    levels: dict[int, DataFrame] = {ORDER: grams.select(F.col("gram").alias("g"), F.col("n").alias("k"))}
    for order in range(ORDER - 1, 0, -1):  # k below the top: the distinct characters before it in trusted text
        above = levels[order + 1]
        levels[order] = written(above.groupBy(F.substring("g", 2, order).alias("g")).agg(F.count_if(F.col("k") > 0).alias("k")), f"grams-{order}")
    below, base = None, None
    for order in range(1, ORDER + 1):
        level = levels[order]
        d = _discounts(level)
        context = F.substring("g", 1, order - 1) if order > 1 else F.lit("")
        level = level.withColumn("context", context)
        seen = level.filter("k > 0").groupBy("context").agg(F.sum("k").alias("total"), *(F.count_if(F.col("k") == i if i < 3 else F.col("k") >= 3).alias(f"n{i}") for i in (1, 2, 3)))
        left = sum(d[i - 1] * F.col(f"n{i}") for i in (1, 2, 3)) / F.col("total")
        seen = seen.select("context", "total", left.alias("left"))
        if order == 1:
            base = 1.0 / (1 + level.filter("k > 0").count())
            joined = level.join(seen, "context", "left").withColumn("lower", F.lit(base))
        else:
            joined = level.join(seen, "context", "left").withColumn("suffix", F.substring("g", 2, order - 1)).join(below.select(F.col("g").alias("suffix"), F.col("p").alias("lower")), "suffix")
        p = F.when(F.col("total").isNull(), F.col("lower")).otherwise(_discounted(F.col("k"), d) / F.col("total") + F.col("left") * F.col("lower"))
        below = written(joined.select("g", p.alias("p")), f"probabilities-{order}")
    return below.select(F.col("g").alias("gram"), F.log("p").alias("log_p"))


def scored(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """row, lang, perplexity and trusted (0 no, 1 learned from, 2 calibrates) of the numbered() rows."""
    ids = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    ids = ids.withColumn("role", F.when(F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0, 2).otherwise(1))
    side = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    keyed = rows.select("row", "doc.doc_id", "doc.text").join(side, "doc_id", "left")
    gathered = keyed.select("row", "text", (F.coalesce("role", F.lit(0)) == 1).alias("trusted")).mapInPandas(_gather, "block long, gram string, n long")
    with text_batches(rows.sparkSession):
        asked = bucketed(gathered, "gram", "asked")
    grams = written(asked.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    known = asked.select("block", "gram").join(probabilities(grams).select("gram", F.col("log_p").cast("float").alias("log_p")), "gram")
    packed = rows.select("row", "doc.text").mapInPandas(_packed, "block long, ids array<long>, sizes array<long>, packed binary")
    pieces = packed.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(_score, "row long, log_p double, n long")
    sums = pieces.groupBy("row").agg(F.sum("log_p").alias("log_p"), F.sum("n").alias("n"))
    roles = rows.select("row", "doc.doc_id", "doc.lang").join(side, "doc_id", "left").select("row", "lang", F.coalesce("role", F.lit(0)).alias("trusted"))
    with text_batches(rows.sparkSession):
        found = written(sums.select("row", F.exp(-F.col("log_p") / F.col("n")).alias("perplexity")), "perplexities")
    return found.join(roles, "row")


def judged(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """row, lang, perplexity, threshold, kept of the numbered() rows, whose doc has doc_id, text, lang."""
    found = scored(rows, labels)
    quantile = F.percentile_approx("perplexity", QUANTILE, 10_000).alias("q")
    calibration = found.filter("trusted = 2")
    by_lang = calibration.groupBy(F.col("lang").alias("own")).agg(quantile, F.count("*").alias("support")).filter(F.col("support") >= SUPPORT).drop("support")
    overall = calibration.agg(quantile).first().q
    overall = found.filter("trusted = 1").agg(quantile).first().q if overall is None else overall
    found = found.join(by_lang, F.col("lang").eqNullSafe(F.col("own")), "left")
    found = found.withColumn("threshold", MARGIN * F.coalesce("q", F.lit(overall).cast("double")))
    return found.select("row", "lang", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps."""
    rows = numbered(docs)
    rejected = judged(rows, labels).filter("not kept").select("row")
    return rows.join(rejected, "row", "left_anti").select("doc.*")


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity, threshold of its language and verdict of every document."""
    rows = numbered(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    found = judged(rows, table(spark, sf_dir, "labels")).drop("lang")
    return rows.select("row", "doc.doc_id", "doc.lang").join(found, "row").select("doc_id", "lang", "perplexity", "threshold", "kept")

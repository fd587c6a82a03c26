"""Token ids in binary files, compressed document by document with a shared dictionary.

A zstandard dictionary is trained on the serialized id arrays of a bounded sample. Documents are dealt into ranges of doc_id,
sorted, encoded, and compressed one by one with it; each range is written as shards in ascending order. A shard row holds the
hash of its dictionary, the ids of its documents, the offsets of their frames and the frames themselves, so that one document is
read by one slice. Ids below 65,536 take two bytes before compression, others four; the shard says which.

Defined cases: a null text is the empty text, of which only the end id is written; a null doc_id sorts first; rows with
the same doc_id are ordered by their text's hash and each returned, and as many of them as there may be are dealt into several
ranges by that hash; an empty table writes no shard and gives an empty result; a very long text is one frame, held by one task in
whole, and ends its shard early; a sample too small to train on leaves the dictionary empty, and frames are then compressed
without; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import fresh_path, table
from tidewell.llm.token_counts import tokenizer_path
from tidewell.llm.tokens import library_encoder

END_ID = 0
#: Documents the dictionary is trained on at most, bytes of each that count, the dictionary's bytes.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 1 << 14, 1 << 16
#: Documents and bytes of a shard, documents of a range on average, ranges at most, shard starts that are broadcast at most.
SHARD_DOCS, SHARD_BYTES, RANGE_DOCS, MOST_RANGES, BROADCAST_ROWS = 512, 16 << 20, 10_000, 32_768, 500_000
SHARD = "bucket int, ordinal int, dictionary string, width int, first_id long, last_id long, doc_ids array<long>, n_tokens array<long>, ends array<long>, frames binary"


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary for frames like the samples; empty where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_hash(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def _context(raw: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}


def _width(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4


def sampled(docs: DataFrame, tokenizer: str, kind: str) -> list[bytes]:
    """Serialized ids of the SAMPLE documents with the least hashes, up to SAMPLE_BYTES of each.

    Tasks send the driver hashes first; the documents they name are encoded in tasks.
    """
    hashed = docs.select("text", F.xxhash64("doc_id", "text").alias("h"))
    last = hashed.select("h").orderBy("h").limit(SAMPLE).agg(F.max("h").alias("h")).first().h
    if last is None:
        return []

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = library_encoder(tokenizer)
        for b in batches:
            for lo, hi, ids, at in own.each_slice(b.column(0)):
                raw = [np.append(ids[at[k] : at[k + 1]], END_ID).astype(kind).tobytes()[:SAMPLE_BYTES] for k in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], ["raw"])

    return sorted(bytes(r.raw) for r in hashed.filter(F.col("h") <= last).select("text").mapInArrow(encode, "raw binary").limit(SAMPLE).collect())


def write_shards(docs: DataFrame, path: str, tokenizer: str) -> str:
    """Writes docs (doc_id, text) to path/dictionary and path/shards; returns path."""
    spark = docs.sparkSession
    width = _width(tokenizer)
    kind = f"<u{width}"
    raw = train_dictionary(sampled(docs, tokenizer, kind))
    name = dictionary_hash(raw)
    spark.createDataFrame([(name, raw)], "dictionary string, raw binary").write.parquet(f"{path}/dictionary")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted; a shard ends at SHARD_DOCS documents, at SHARD_BYTES, or with its range."""
        own, z = library_encoder(tokenizer), zstandard.ZstdCompressor(level=3, write_content_size=True, **_context(raw))
        bucket, ordinal = TaskContext.get().partitionId(), 0
        doc_ids, sizes, frames = [], [], []

        def shard() -> pa.RecordBatch:
            nonlocal ordinal
            known = [x for x in doc_ids if x is not None]
            row = {"bucket": bucket, "ordinal": ordinal, "dictionary": name, "width": width, "first_id": min(known, default=None), "last_id": max(known, default=None), "doc_ids": [*doc_ids], "n_tokens": [*sizes], "ends": np.cumsum([*map(len, frames)]).tolist(), "frames": b"".join(frames)}
            ordinal += 1
            for x in (doc_ids, sizes, frames):
                x.clear()
            return pa.RecordBatch.from_pylist([row], SHARD_ARROW)

        for b in batches:
            ids_of = b.column(0).to_pylist()
            for lo, hi, ids, at in own.each_slice(b.column(1)):
                for k in range(hi - lo):
                    doc_ids.append(ids_of[lo + k])
                    sizes.append(int(at[k + 1] - at[k]) + 1)
                    frames.append(z.compress(np.append(ids[at[k] : at[k + 1]], END_ID).astype(kind).tobytes()))
                    if len(frames) == SHARD_DOCS or (len(frames[-1]) > SHARD_BYTES // SHARD_DOCS and sum(map(len, frames)) > SHARD_BYTES):
                        yield shard()
        if frames:
            yield shard()

    order = [F.asc_nulls_first("doc_id"), F.asc("tie")]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ranges = min(MOST_RANGES, max(1, docs.count() // RANGE_DOCS))
    keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(shards, SHARD).write.parquet(f"{path}/shards")
    return path


SHARD_ARROW = pa.schema([
    ("bucket", pa.int32()), ("ordinal", pa.int32()), ("dictionary", pa.string()), ("width", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("frames", pa.binary()),
])


def _dictionaries(spark: SparkSession, path: str) -> dict[str, bytes]:
    """One row, of DICTIONARY_BYTES at most."""
    return {r.dictionary: bytes(r.raw) for r in spark.read.parquet(f"{path}/dictionary").collect()}


def _decompressor(dictionaries: dict[str, bytes], name: str) -> zstandard.ZstdDecompressor:
    if dictionary_hash(dictionaries[name]) != name:
        raise ValueError("the dictionary isn't the one that the shard was written with")
    return zstandard.ZstdDecompressor(**_context(dictionaries[name]))


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Ids of the documents with this id in the files at path: the statistics of the files leave the shards around it, and of each
    only its own frame is sliced and decompressed."""
    at = F.array_position("doc_ids", F.lit(doc_id)).cast("int")
    found = spark.read.parquet(f"{path}/shards").filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id) & (at > 0))
    places = found.withColumn("k", F.explode(F.filter(F.sequence(F.lit(1), F.size("doc_ids")), lambda k: F.element_at("doc_ids", k) == doc_id)))
    begin = F.when(F.col("k") > 1, F.element_at("ends", F.col("k") - 1)).otherwise(0).cast("int")
    frame = F.substring(F.col("frames"), begin + 1, F.element_at("ends", F.col("k")).cast("int") - begin)
    known = _dictionaries(spark, path)
    rows = places.orderBy("bucket", "ordinal", "k").select("dictionary", "width", frame.alias("frame")).collect()
    return [np.frombuffer(_decompressor(known, r.dictionary).decompress(bytes(r.frame)), f"<u{r.width}").tolist() for r in rows]


def read_documents(spark: SparkSession, path: str, of, schema: str) -> DataFrame:
    """of(doc_id, start, ids) of every document in the files at path, as rows of schema."""
    stored = spark.read.parquet(f"{path}/shards")
    # starts: running sums over the buckets, which are few, and over the shards inside each
    sums = stored.select("bucket", "ordinal", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    whole = sums.groupBy("bucket").agg(F.sum("n").alias("n")).select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = sums.withColumn("n", F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = inner.join(F.broadcast(whole), "bucket").select("bucket", "ordinal", (F.col("base") + F.col("n")).alias("start"))
    if stored.select("bucket").count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    dictionaries = _dictionaries(spark, path)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                z = _decompressor(dictionaries, r.dictionary)
                at, begin, rows = int(r.start), 0, []
                for doc_id, n, stop in zip(r.doc_ids, r.n_tokens, r.ends, strict=True):
                    ids = np.frombuffer(z.decompress(r.frames[begin:stop]), f"<u{r.width}").astype("<u4")
                    if len(ids) != n:
                        raise ValueError("a frame's length differs from the index")
                    rows.append(of(None if pd.isna(doc_id) else int(doc_id), at, ids))
                    at, begin = at + int(n), stop
                out = pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])
                yield out.astype({"doc_id": "Int64"})

    return stored.join(starts, ["bucket", "ordinal"]).select("dictionary", "width", "doc_ids", "n_tokens", "ends", "frames", "start").mapInPandas(decode, schema)


def op6_zstd_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the ids of every document start, how many they are, and their checksum, as read back from the files."""
    path = write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), fresh_path(spark, "token-files"), tokenizer_path())
    return read_documents(spark, path, lambda doc_id, start, ids: (doc_id, start, len(ids), zlib.crc32(ids.tobytes())), "doc_id long, start long, n_tokens long, ids_crc32 long")

"""Token counts with a digest cache.

A table keeps the token count of every content seen, under the content's SHA-256 and a digest of tokenizer file and library
version. Counting joins the distinct contents of the documents to it, encodes only those that are missing, and appends them;
the counts of all documents are then read from the table. Texts travel to that join compressed, one of each content from
each task. The content that the digest names is the text as it is: folding it first would change its tokens.

Defined cases: a null text is the empty text (0 bytes, 0 tokens); rows with the same doc_id or text are each returned; a very
long text is held by a task in whole, alone where it is longer than a slice; an empty table gives an empty result and appends
nothing; other columns are ignored. A run that fails between its append and
its end leaves rows in the cache that a later run finds; repeated rows of a key agree and are read as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import fresh_path, table
from tidewell.llm.tokens import SLICE, library_encoder, tokenizer_digest

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
CACHE = "content binary, tokenizer string, n_bytes long, n_tokens long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    press = zstandard.ZstdCompressor(level=3)
    for b in batches:
        b = b.drop_duplicates("content")
        yield pd.DataFrame({"content": b["content"], "packed": [press.compress(t.encode("utf-8", "surrogatepass")) for t in b["text"]]})


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table at path, made empty where there is none."""
    spark.createDataFrame([], CACHE).write.mode("append").parquet(path)
    return spark.read.schema(CACHE).parquet(path)


def counted(docs: DataFrame, cache: str, tokenizer: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of docs (doc_id, text) through the cache table at the path cache."""
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("content", F.unhex(F.sha2("text", 256)))
    stored = open_cache(spark, cache).filter(F.col("tokenizer") == version)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, undo = library_encoder(tokenizer), zstandard.ZstdDecompressor()

        def answer(contents: list[bytes], raw: list[bytes]) -> pa.RecordBatch:
            counts = np.concatenate([np.diff(at) for _, _, _, at in encoder.each_slice(pa.array(raw, pa.binary()))])
            columns = [pa.array(contents, pa.binary()), pa.array([version] * len(raw)), pa.array([*map(len, raw)], pa.int64()), pa.array(counts, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["content", "tokenizer", "n_bytes", "n_tokens"])

        for b in batches:
            contents, raw, held = [], [], 0
            for content, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                contents.append(content)
                raw.append(undo.decompress(packed))
                held += len(raw[-1])
                if held > SLICE:  # what a task holds decompressed
                    yield answer(contents, raw)
                    contents, raw, held = [], [], 0
            if raw:
                yield answer(contents, raw)

    # the copies of a content meet in each task first, then in one row by digest; the join by digest needs no other shuffle
    distinct = keyed.select("content", "text").mapInPandas(_packed, "content binary, packed binary").groupBy("content").agg(F.first("packed").alias("packed"))
    misses = distinct.join(stored.select("content").distinct(), "content", "left_anti")
    misses.select("content", "packed").mapInArrow(count, CACHE).write.mode("append").parquet(cache)
    known = spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == version).groupBy("content").agg(F.first("n_bytes").alias("n_bytes"), F.first("n_tokens").alias("n_tokens"))
    return keyed.select("doc_id", "content").join(known, "content").select("doc_id", "n_bytes", "n_tokens")


def op5_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, counted through a cache that starts empty."""
    found = counted(table(spark, sf_dir, "documents"), fresh_path(spark, "token-counts"), tokenizer_path())
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))

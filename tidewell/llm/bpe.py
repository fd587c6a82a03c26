"""Byte-level BPE from a rank file, encoding and decoding, with DuckDB inside each partition.

Encoding: a task splits its texts by the pattern and keeps its distinct words. Words that are tokens are done. The others
become rows of token positions, which a recursive DuckDB query joins to the merge table; every turn contracts the leftmost
pair of least rank of each word, and with it the further pairs of that rank, as long as none of the tokens so made pairs up with
a neighbour at a lesser rank (then that pair would come first, and the turn ends there). A word without a pair that merges leaves
the recursion. Decoding: ids join the vocabulary's bytes and an aggregate ordered by position puts them together.

Nothing is shuffled: words are shared within a task only, and the memory of them is bounded. DuckDB writes no file.

Defined cases: a null text is the empty text, which has no ids and decodes to no bytes; rows with the same doc_id or text are
each returned; an empty table gives an empty result; columns besides doc_id and text are ignored by encode(), kept by decode().
A very long text is held by a task in whole. A very long word is merged alone, by as many turns as different ranks take part in
it: 46 s for one of 100,000 random letters, and for one letter repeated in time and memory by the square of its length (20,000: 6 s and
640 MB, 50,000: 27 s and 1,158 MB; 200,000 need more than an executor's memory). An id outside the vocabulary raises an error when decoded.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import table, text_batches, written
from tidewell.llm.tokens import ChunkEncoder, slices

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bytes of the words of one recursive query, remembered words, ids decoded at once.
QUERY_BYTES, MOST_WORDS, IDS = 1 << 19, 400_000, 300_000

#: One turn: the pairs that merge, each word's least rank and leftmost place of it, and the contraction. Words of more than 32 tokens
#: contract all places of their least rank that are sure: of neighbouring places every other one, up to the first whose new token
#: would merge at a lesser rank.
MERGE = """
with recursive turn(word, ids) using key (word) as (
    select word, ids from words
    union all
    select word, ids from (
        with least as (
            select word, (min(key) >> 32)::int as rank, (min(key) & 4294967295)::int as pos, list(key) filter (where size > 32) as keys
            from (
                select word, size, (merges.rank::bigint << 32) | pos as key
                from (select word, size, pos, ids[pos] as a, ids[pos + 1] as b from (select word, ids, len(ids) as size, unnest(range(1, len(ids))) as pos from turn)) positions
                join merges using (a, b)
            ) pairs
            group by word
        ), places as (
            select word, rank, (unnest(list_filter(keys, lambda k: (k >> 32) = rank)) & 4294967295)::int as pos from least where keys is not null
        ), runs as (
            select word, rank, pos, pos - row_number() over (partition by word order by pos) as run from places
        ), chosen as (
            select word, rank, pos, lag(pos) over (partition by word order by pos) as before
            from (select *, row_number() over (partition by word, run order by pos) as nth from runs) where nth % 2 = 1
        ), around as (
            select word, rank, pos, if(before = pos - 2, rank, if(pos > 1, ids[pos - 1], null)) as previous, ids[pos + 2] as next
            from chosen join turn using (word)
        ), stops as (
            select word, min(pos) as stop from (
                select word, pos from around join merges on a = previous and b = around.rank and merges.rank < around.rank
                union all
                select word, pos from around join merges on a = around.rank and b = next and merges.rank < around.rank
            ) group by word
        ), sure as (
            select word, any_value(rank) as rank, list(pos order by pos) as spots from chosen left join stops using (word) where stop is null or pos <= stop group by word
        )
        select word, list_concat(list_slice(ids, 1, pos - 1), [rank], list_slice(ids, pos + 2, len(ids))) as ids from turn join least using (word) where keys is null
        union all
        select word, list_concat(list_slice(ids, 1, spots[1] - 1), flatten(list_transform(range(1, len(spots) + 1),
            lambda i: list_concat([rank], list_slice(ids, spots[i] + 2, if(i < len(spots), spots[i + 1] - 1, len(ids))))))) as ids from turn join sure using (word)
    ) turned
)
select ids from turn order by word
"""
#: The rows are ordered before they are aggregated, by one thread, which keeps their order; that is a third of the time of an order
#: inside the aggregate.
DECODE = "select doc, unhex(string_agg(hex, '')) as bytes, count(*) as n from (select doc, hex from ids join vocabulary using (id) order by doc, pos) ordered group by doc"


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """a, b, rank: every pair of tokens that make up a token, whose rank is its id."""
    found = [(a, b, r) for token, r in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None]
    a, b, r = (pa.array([row[k] for row in found], pa.int32()) for k in range(3))
    return pa.table({"a": a, "b": b, "rank": r})


def _database():
    import duckdb

    con = duckdb.connect(":memory:")
    con.execute("set threads = 1")
    con.execute("set memory_limit = '256MB'")
    con.execute("set temp_directory = ''")
    return con


class Words:
    """Ids of texts, by their distinct words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.pattern = regex.compile(pattern)
        self.words: dict[bytes, bytes] = {}
        self.con = _database()
        self.con.register("given", merge_table(ranks))
        self.con.execute("create table merges as select * from given")

    def merged(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words by the recursive query."""
        ends = np.cumsum([0, *map(len, words)])
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]))
        self.con.register("words", pa.table({"word": pa.array(range(len(words)), pa.int32()), "ids": ids}))
        found = self.con.sql(MERGE).to_arrow_table().column("ids").combine_chunks()
        flat, cuts = found.values.to_numpy().astype("<u4"), found.offsets.to_numpy()
        return np.split(flat[cuts[0] : cuts[-1]], cuts[1:-1] - cuts[0])

    def learn(self, words: set[bytes]) -> None:
        """Adds words to the memory; words of one query are about as long as each other and so take about as many turns."""
        merging = []
        for w in words:
            if (r := self.ranks.get(w)) is not None:
                self.words[w] = np.uint32(r).tobytes()
            else:
                merging.append(w)
        merging.sort(key=len)
        for lo, hi in slices(np.fromiter(map(len, merging), np.int64, len(merging)), QUERY_BYTES):
            self.words.update(zip(merging[lo:hi], map(np.ndarray.tobytes, self.merged(merging[lo:hi])), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > MOST_WORDS:
            self.words.clear()
        parts = [[w.encode("utf-8", "surrogatepass") for w in self.pattern.findall(t)] for t in texts]
        self.learn(set().union(*parts).difference(self.words))
        return [np.frombuffer(b"".join(map(self.words.__getitem__, p)), "<u4") for p in parts]


def word_encoder(path: str, pattern: str) -> ChunkEncoder:
    ranks = read_ranks(path)
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return ChunkEncoder(Words(ranks, pattern).encode, sizes)


class WordDecoder:
    """Bytes that lists of ids stand for."""

    def __init__(self, path: str) -> None:
        tokens = read_ranks(path)
        self.con = _database()
        self.con.register("given", pa.table({"id": pa.array(tokens.values(), pa.int32()), "hex": pa.array([t.hex() for t in tokens])}))
        self.con.execute("create table vocabulary as select * from given")

    def decode(self, lists: pa.ListArray) -> Iterator[tuple[int, int, list[bytes]]]:
        """Runs of the lists (from, to) of about IDS ids, with their bytes."""
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        cuts = np.unique(np.searchsorted(np.cumsum(sizes), np.arange(IDS, sizes.sum() + IDS, IDS), side="right"))
        for lo, hi in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
            if hi == lo:
                continue
            n, out = sizes[lo:hi], [b""] * (hi - lo)
            self.con.register("ids", pa.table({"doc": np.repeat(np.arange(hi - lo, dtype=np.int32), n), "pos": np.arange(n.sum(), dtype=np.int32), "id": lists[lo:hi].flatten()}))
            found = self.con.sql(DECODE).to_arrow_table()
            right = 0
            for doc, text, count in zip(*(found.column(c).to_pylist() for c in ("doc", "bytes", "n")), strict=True):
                out[doc] = text
                right += count == n[doc]
            if right != (n > 0).sum():
                raise ValueError("an id isn't in the vocabulary")
            yield lo, hi, out


def _encoded(encoder: ChunkEncoder, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """doc_id, ids of a batch of doc_id, text."""
    for lo, hi, ids, at in encoder.each_slice(b.column(1)):
        yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.view(np.int32)))], ["doc_id", "ids"])


def _decoded(decoder: WordDecoder, b: pa.RecordBatch, into: str) -> Iterator[pa.RecordBatch]:
    """b with the bytes of its ids."""
    for lo, hi, out in decoder.decode(b.column(b.schema.get_field_index("ids"))):
        yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, pa.array(out, pa.binary())], [*b.schema.names, into])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids of docs (doc_id, text): each text whole, without special tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path, pattern)
        for b in batches:
            yield from _encoded(encoder, b)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, into: str = "decoded") -> DataFrame:
    """encoded (ids, ...) with the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = WordDecoder(path)
        for b in batches:
            yield from _decoded(decoder, b, into)

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(into, T.BinaryType())]))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """decode(encode(docs)) in one Python worker a task instead of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = word_encoder(path, pattern), WordDecoder(path)
        for b in batches:
            for part in _encoded(encoder, b):
                yield from _decoded(decoder, part, "decoded")

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame) -> DataFrame:
    """Token count and digests of ids and decoded bytes of docs (doc_id, text), with the public rank file."""
    import public_tokenizers

    found = round_trip(docs, ranks_path(), public_tokenizers.PATTERN)
    found = found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    with text_batches(docs.sparkSession):
        return written(found, "token-digests")


def op2_recursive_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of what they decode to."""
    return digests(table(spark, sf_dir, "documents"))

"""Hybrid retrieval for batches of questions: postings, dense neighbours, rank fusion, evidence.

Nothing here is collected to the driver but index centroids, whose number is a parameter, and up to MOST_QUERIES question vectors,
which are counted first and sent to the tasks as one matrix; larger batches are dealt into blocks, or go through the bucketed index.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.config import SETTINGS

#: Letters with accents and what they become, in the analyser that SQL can repeat.
ACCENTED, PLAIN = "áàâäãéèêëíìîïóòôöõúùûüñç", "aaaaaeeeeiiiiooooouuuunc"
#: Question vectors that are sent to every task at most (about 5 MB of 64 doubles each), and how many meet a batch of chunks at once.
MOST_QUERIES = 10_000
QUERY_BLOCK = 256
#: Parts of the chunks that blocks of more questions meet.
CHUNK_PARTS = 64
#: Rows of a table beside the chunks (ready documents, found chunks, terms) that are sent to every task at most, so that the chunks stay where they are.
MOST_SENT = 1_000_000


def sent(rows: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """rows with a broadcast hint if they are few, which is counted; a larger table is shuffled as any other."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def ready(docs: DataFrame) -> DataFrame:
    """The documents that questions read from, for retrievable(), counted once."""
    return sent(docs.filter("status = 'ready'").select("id", "filename", "status"))


def retrievable(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks with a vector of ready documents: the only place that questions read from."""
    ready = docs.filter("status = 'ready'").select(F.col("id").alias("document_id"), "filename")
    return chunks.filter("embedding is not null").join(ready, "document_id")


def terms(text: Column) -> Column:
    """Lower-case words without accents."""
    return F.filter(F.split(F.translate(F.lower(text), ACCENTED, PLAIN), "[^a-z0-9]+"), lambda t: t != "")


def stemmed(word: str) -> str:
    """A light Spanish stem: plural and gender endings, then a few suffixes of words long enough to lose them."""
    for suffix in ("amientos", "imientos", "amiento", "imiento", "aciones", "uciones", "acion", "ucion", "mente", "idades", "idad", "ables", "ibles", "able", "ible", "istas", "ista", "ando", "iendo", "ados", "idos", "adas", "idas", "ado", "ido", "ada", "ida"):
        if word.endswith(suffix) and len(word) - len(suffix) >= 4:
            return word[: -len(suffix)]
    for suffix in ("es", "os", "as", "s", "o", "a", "e"):
        if word.endswith(suffix) and len(word) - len(suffix) >= 3:
            return word[: -len(suffix)]
    return word


def analysed(chunks: DataFrame, stop: list[str], stem: Callable[[str], str] | None = stemmed, carry: tuple[str, ...] = ()) -> DataFrame:
    """document_id, ordinal, carried columns, pos, term: words that aren't stop words, stemmed. Each distinct word is stemmed once."""
    tokens = chunks.select("document_id", "ordinal", *carry, F.posexplode(terms(F.col("content"))).alias("pos", "word")).filter(~F.col("word").isin(*stop))
    if stem is None:
        return tokens.withColumnRenamed("word", "term")

    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(stem)

    known = tokens.select("word").distinct().withColumn("term", stems("word"))
    return tokens.join(known, "word").select("document_id", "ordinal", *carry, "pos", "term")


def postings(tokens: DataFrame) -> DataFrame:
    """term, document_id, ordinal, tf, positions."""
    return tokens.groupBy("term", "document_id", "ordinal").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("qid", F.explode(F.array_distinct(terms(F.col("question")))).alias("term"))


def or_matches(queries: DataFrame, index: DataFrame) -> DataFrame:
    """qid and chunk for every term of a question that the chunk has; a question without terms matches nothing."""
    return query_terms(queries).join(index, "term")


def matching(index: DataFrame, queries: DataFrame) -> DataFrame:
    """The postings of the questions' terms alone, before anything else is joined to them."""
    return index.join(query_terms(queries).select("term").distinct(), "term", "left_semi")


def lexical_scores(queries: DataFrame, index: DataFrame) -> DataFrame:
    """A tenth for every matched position."""
    return summed_scores(or_matches(queries, index))


def summed_scores(matches: DataFrame) -> DataFrame:
    return matches.groupBy("qid", "document_id", "ordinal").agg(F.round(F.sum("tf") * F.lit(0.1), 6).alias("score"))


def hashed_embedding(texts: list[str], dimension: int = SETTINGS.dimension) -> np.ndarray:
    """Feature hashing of words, signed counts in a row a text; the same everywhere, with no model. Unit length is for normalised().

    A word's first 32 bits of MD5 choose its place and sign. A text without words has the zero vector.
    """
    folded = str.maketrans(ACCENTED, PLAIN)
    found = [re.findall("[a-z0-9]+", text.lower().translate(folded)) for text in texts]
    row = np.repeat(np.arange(len(texts)), [len(words) for words in found])
    at = np.fromiter((_place(w, dimension) for words in found for w in words), np.int64, len(row))
    counts = np.bincount(row * 2 * dimension + at, minlength=len(texts) * 2 * dimension).reshape(len(texts), 2 * dimension)
    return (counts[:, :dimension] - counts[:, dimension:]).astype(np.float32)


@functools.lru_cache(200_000)
def _place(word: str, dimension: int) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % (2 * dimension)


def embedder(embed: Callable[[list[str]], np.ndarray] = hashed_embedding, batch: int = SETTINGS.embed_batch):
    """An iterator UDF text -> array<float> around any embedding function, which gets a list of texts and gives a row for each."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            whole = [t or "" for t in texts]
            yield pd.Series([row for at in range(0, len(whole), batch) for row in np.asarray(embed(whole[at : at + batch]), np.float32)])

    return run


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def normalised(v: Column) -> Column:
    """A unit vector; null for a zero vector or one of the wrong dimension is for the caller to filter."""
    # the length is bound to a name, or it would be worked out again for every component
    unit = F.transform(F.array(F.sqrt(dot(v, v))), lambda n: F.transform(v, lambda x: x / n))
    return F.when(dot(v, v) > 0, F.element_at(unit, 1))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Catalyst limits each task's groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def nearest_in_tasks(queries: DataFrame, chunks: DataFrame, k: int, key: list[str]) -> DataFrame:
    """qid, key, score: each task's nearest k chunks of every question, by products of matrices; pairs never become rows."""
    asked = queries.select("qid", "qvec").filter("qvec is not null").toPandas()
    qids, q = asked["qid"].to_numpy(), np.array(asked["qvec"].tolist(), float)
    order, up = ["qid", "score", *key], [True, False, *(True for _ in key)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for chunk in batches:
            if not len(chunk) or not len(q):
                continue
            v, n = np.stack(chunk["vec"].to_numpy()).T, len(chunk)
            for at in range(0, len(q), QUERY_BLOCK):
                score = np.round(q[at : at + QUERY_BLOCK] @ v, 6) + 0.0
                least = np.partition(score, n - k, axis=1)[:, n - k, None] if n > k else np.full((len(score), 1), -np.inf)
                # ties of the k-th score stay until the keys decide
                who, what = np.nonzero(score >= least)
                found = chunk[key].iloc[what].assign(qid=qids[at + who], score=score[who, what])
                found = found.sort_values(order, ascending=up).groupby("qid", sort=False).head(k)
                best = found if best is None else pd.concat([best, found])
            best = best.sort_values(order, ascending=up).groupby("qid", sort=False).head(k)
        if best is not None:
            yield best[["qid", *key, "score"]]

    types = {f.name: f.dataType.simpleString() for f in [*queries.schema, *chunks.schema]}
    schema = ", ".join([f"qid {types['qid']}", *(f"`{c}` {types[c]}" for c in key), "score double"])
    return chunks.select(*key, "vec").mapInPandas(run, schema)


def dense_top_k(queries: DataFrame, chunks: DataFrame, k: int, key: list[str]) -> DataFrame:
    """Exact neighbours: 1 - cosine distance of every question (qid, qvec) to every chunk (key, vec), unit vectors of doubles.

    Up to MOST_QUERIES questions go to the chunks, which stay where they are. More are dealt into blocks of about that
    many by hash; each block meets each part of the chunks in a group of its own, which keeps the first k of each question
    before the rest of the groups is looked at. Rows without a vector have no neighbours and are none.
    """
    chunks = chunks.filter("vec is not null")
    n = queries.count()
    order = [F.desc("score"), *map(F.col, key)]
    if n <= MOST_QUERIES:
        return top_k(nearest_in_tasks(queries, chunks, k, key), ["qid"], order, k)
    score = F.round(dot(F.col("qvec"), F.col("vec")), 6).alias("score")
    blocks = math.ceil(n / MOST_QUERIES)
    asked = queries.filter("qvec is not null").withColumn("_block", F.pmod(F.xxhash64("qid"), F.lit(blocks))).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(CHUNK_PARTS - 1))))
    dealt = chunks.withColumn("_part", F.pmod(F.xxhash64(*key), F.lit(CHUNK_PARTS)).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    scored = dealt.join(asked.hint("shuffle_merge"), ["_block", "_part"]).select("qid", "_part", *key, score)
    partial = top_k(scored, ["qid", "_part"], order, k).drop("rank", "_part")
    return top_k(partial, ["qid"], order, k)


def centroids(chunks: DataFrame, lists: int, sample: int = 10_000) -> np.ndarray:
    """Centres of an inverted-file index, by Lloyd's rounds over a bounded sample; every chunk is indexed later."""
    rows = chunks.select("vec").orderBy(F.xxhash64("vec")).limit(sample).collect()
    x = np.array([r.vec for r in rows])
    if not len(x):
        return np.zeros((0, SETTINGS.dimension))
    centres = x[:: max(1, len(x) // lists)][:lists].copy()
    for _ in range(8):
        near = np.argmax(x @ centres.T, axis=1)
        for c in range(len(centres)):
            if (near == c).any():
                m = x[near == c].mean(axis=0)
                centres[c] = m / (np.linalg.norm(m) or 1.0)
    return centres


def nearest_lists(centres: np.ndarray, probes: int) -> Callable[[Column], Column]:
    """Column function: the numbers of the probes nearest centres of a vector."""

    @F.pandas_udf("array<int>")
    def run(vectors: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(v, float) for v in vectors]) if len(vectors) else np.zeros((0, centres.shape[1]))
        return pd.Series([row.tolist() for row in np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes]])

    return run.asNondeterministic()  # so that no filter on what it gives is moved to where it can't run


def bucketed_top_k(queries: DataFrame, chunks: DataFrame, k: int, key: list[str], lists: int = 32, probes: int = 22) -> DataFrame:
    """Approximate neighbours: chunks in lists by nearest centre, questions compared with their probes nearest lists."""
    centres = centroids(chunks, lists)
    indexed = chunks.withColumn("list", F.element_at(nearest_lists(centres, 1)(F.col("vec")), 1))
    asked = queries.withColumn("lists", nearest_lists(centres, min(probes, max(1, len(centres))))(F.col("qvec"))).withColumn("list", F.explode("lists"))
    scored = asked.join(indexed, "list").select("qid", *key, F.round(dot(F.col("qvec"), F.col("vec")), 6).alias("score"))
    return top_k(scored, ["qid"], [F.desc("score"), *map(F.col, key)], k)


def fused(dense: DataFrame, lexical: DataFrame, key: list[str], k: int, rrf: int = SETTINGS.rrf_k) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (qid, key, rank); a list that lacks a chunk adds nothing."""
    a = dense.select("qid", *key, F.col("rank").alias("dense_rank"))
    b = lexical.select("qid", *key, F.col("rank").alias("lexical_rank"))
    part = lambda r: F.coalesce(1.0 / (rrf + F.col(r)), F.lit(0.0))
    both = a.join(b, ["qid", *key], "full_outer").withColumn("score", F.round(part("dense_rank") + part("lexical_rank"), 9))
    return top_k(both, ["qid"], [F.desc("score"), *map(F.col, key)], k)


def rrf_share(score: Column, rrf: int = SETTINGS.rrf_k) -> Column:
    """A fused score as a share of the best that there can be."""
    return F.least(F.lit(1.0), score / (2.0 / (rrf + 1)))


def overlap_score(question: Column, heading: Column, content: Column) -> Column:
    """Two points for a question's term in the heading, one for a term in the body alone, against 1.3 for each term."""
    q = F.array_distinct(terms(question))
    h, c = F.array_distinct(terms(heading)), F.array_distinct(terms(content))
    in_heading = F.size(F.array_intersect(q, h))
    in_body = F.size(F.array_intersect(F.array_except(q, h), c))
    return F.round(F.least(F.lit(0.99), (2 * in_heading + in_body) / F.greatest(F.lit(1.0), 1.3 * F.size(q))), 6)


def pair_scorer(score: Callable[[list[str], list[str]], np.ndarray]):
    """A UDF (question, content) -> double around any scorer of pairs, which gets them a batch at a time."""

    @F.pandas_udf("double")
    def run(questions: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series(score(questions.tolist(), contents.tolist()), dtype=float)

    return run


def reranked(candidates: DataFrame, score: Column, key: list[str], k: int) -> DataFrame:
    """Candidates with their score replaced, the best k of each question."""
    return top_k(candidates.withColumn("score", score).drop("rank"), ["qid"], [F.desc("score"), *map(F.col, key)], k)


def evidence_gate(queries: DataFrame, ranked: DataFrame, threshold: float = SETTINGS.min_relevance_score) -> DataFrame:
    """qid, evidence: does the best score reach the threshold? Questions without rows have none."""
    best = ranked.groupBy("qid").agg(F.max("score").alias("best"))
    return queries.select("qid").join(best, "qid", "left").select("qid", F.coalesce(F.col("best") >= threshold, F.lit(False)).alias("evidence"))


def with_evidence(ranked: DataFrame, gate: DataFrame) -> DataFrame:
    """Rows of questions that have evidence; of others none."""
    return ranked.join(gate.filter("evidence").select("qid"), "qid", "left_semi")


def revalidated(ranked: DataFrame, view: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows still in the newest view, and how many of each question were withdrawn."""
    now = view.select(*key).distinct()
    return ranked.join(now, key, "left_semi"), ranked.join(now, key, "left_anti").groupBy("qid").agg(F.count("*").alias("withdrawn"))


def enriched(question: Column, procedure: Column) -> Column:
    """The question after the procedure, where one is known."""
    return F.when(procedure.isNotNull(), F.concat(procedure, F.lit(": "), question)).otherwise(question)


def citation(filename: Column, heading: Column, page: Column) -> Column:
    return F.concat_ws(" › ", filename, heading, F.when(page.isNotNull(), F.concat(F.lit("p. "), page.cast("string"))))


def embedding_text(heading: Column, content: Column) -> Column:
    return F.concat_ws("\n\n", heading, content)


def valid_questions(queries: DataFrame, k: int) -> DataFrame:
    """Questions that say something, trimmed; k must be from 1 to 20."""
    if not 1 <= k <= 20:
        raise ValueError("k must be from 1 to 20")
    return queries.withColumn("question", F.trim("question")).filter("question != ''")


def lexical_top_k(queries: DataFrame, index, view: DataFrame, docs: DataFrame, k: int, key: list[str]) -> DataFrame:
    """The best k chunks of the view (retrievable chunks of docs) by lexical_scores().

    index: a stored one (operators.index.Index), which opens few blocks, or a table of postings, where the questions' terms
    cut the postings before the view does.
    """
    if not isinstance(index, DataFrame):
        return index.top_k(queries, k, only=lambda rows: retrievable(rows.withColumn("embedding", F.lit(True)), docs).select(*rows.columns))
    seen = matching(index, queries).join(view.select(*key), key, "left_semi")
    return top_k(lexical_scores(queries, seen), ["qid"], [F.desc("score"), *map(F.col, key)], k)


def consult(queries: DataFrame, chunks: DataFrame, docs: DataFrame, index, k: int = SETTINGS.context_top_k, pool: int = SETTINGS.retrieve_top_k, gate: str = "lexical") -> DataFrame:
    """Fragments for each question: hybrid candidates, pair scores, revalidation, evidence.

    chunks: document_id, ordinal, heading, content, embedding; queries: qid, question, qvec; index as for lexical_top_k(). gate "reference" takes the fused
    score alone, which any retrievable chunk passes; "lexical" takes the pair score.
    """
    key = ["document_id", "ordinal"]
    asked = valid_questions(queries, k)
    view = retrievable(chunks, docs)
    vectors = view.select(*key, normalised(doubles(F.col("embedding"))).alias("vec")).filter("vec is not null")
    deep = 2 * max(pool, k)
    dense = dense_top_k(asked.select("qid", "qvec"), vectors, deep, key)
    lexical = lexical_top_k(asked, index, view, docs, deep, key)
    candidates = fused(dense, lexical, key, max(pool, k))
    shown = candidates.join(view.select(*key, "filename", "heading", "content"), key).join(asked.select("qid", "question"), "qid")
    score = F.round(rrf_share(F.col("score")), 6) if gate == "reference" else overlap_score(F.col("question"), F.col("heading"), F.col("content"))
    best = reranked(shown, score, key, k)
    still, _ = revalidated(best, view, key)
    kept = with_evidence(still, evidence_gate(asked, still))
    return kept.select("qid", *key, "rank", "score", citation(F.col("filename"), F.col("heading"), F.lit(None).cast("int")).alias("citation"), "content")

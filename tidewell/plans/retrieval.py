"""Indexing and retrieval over the driver's tables: all lines of all documents are chunks, benchmark passages are questions.

Chunks and questions have the vectors of the library's own embedder, so that every line can be found; the table of embeddings is searched
by ix6 to ix8. The index of a session's tables is written once, by the first query that reads it, and again if the documents change.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import ann as A
from tidewell.operators import evaluation as E
from tidewell.operators import index as I
from tidewell.operators import retrieval as R
from tidewell.plans import standins as S
from tidewell.plans.registry import query
from tidewell.streaming.run import folder

STOP = ["de", "la", "que", "el", "en", "y", "a", "los", "the", "of", "and", "to", "in", "der", "die", "und", "et", "le", "les"]
KEY = ["document_id", "ordinal"]


#: Folders of the indexes that this process wrote, by application, tables and the documents' time of change.
STORED: dict[tuple, str] = {}


def plain_chunks(spark, d) -> DataFrame:
    return S.lines(spark, d).select("document_id", F.col("line_no").alias("ordinal"), F.col("lang").alias("heading"), "content")


def stored(spark, d) -> I.Index:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    changed = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getModificationTime()
    known = (spark.sparkContext.applicationId, d, changed)
    if known not in STORED:
        path = folder(spark)
        I.update(spark, path, plain_chunks(spark, d), stop=STOP)
        STORED[known] = path
    return I.Index(spark, STORED[known])


def chunks(spark, d) -> DataFrame:
    """Every line of every document, with the vector of its heading and text."""
    return stored(spark, d).chunks()


def questions(spark, d) -> DataFrame:
    """The benchmark's passages with their vectors."""
    asked = S.read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.coalesce("text", F.lit("")).alias("question"))
    return asked.withColumn("embedding", R.embedder()("question")).select("qid", "question", R.normalised(R.doubles(F.col("embedding"))).alias("qvec"))


def given_questions(spark, d) -> DataFrame:
    """The benchmark's items, each with the given vector of its number."""
    given = S.read(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), R.normalised(R.doubles(F.col("embedding"))).alias("qvec"))
    return S.read(spark, d, "benchmark").select(F.col("item_id").alias("qid")).join(given, "qid")


def vectors(spark, d) -> DataFrame:
    return S.read(spark, d, "embeddings").select("vec_id", R.normalised(R.doubles(F.col("embedding"))).alias("vec")).filter("vec is not null")


TERMS = f"list_filter(string_split_regex(translate(lower({{}}), '{R.ACCENTED}', '{R.PLAIN}'), '[^a-z0-9]+'), lambda t: t <> '')"
STOPS = ", ".join(f"'{w}'" for w in STOP)
#: A vector as hashed_embedding() makes it, from a list of words, and its unit vector.
PLACES = "list_transform({}, lambda t: CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 128)"
COUNTS = "list_transform(range(64), lambda i: CAST(len(list_filter(p, lambda x: x = i)) - len(list_filter(p, lambda x: x = i + 64)) AS DOUBLE))"
UNIT = "list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y))))"
CTES = {
    "lines": S.SQL["lines"],
    "docs": S.SQL["docs"],
    "tokens": f"SELECT document_id, ordinal, term FROM (SELECT document_id, line_no AS ordinal, unnest({TERMS.format('content')}) AS term FROM lines) WHERE term NOT IN ({STOPS})",
    "postings": "SELECT term, document_id, ordinal, count(*) AS tf FROM tokens GROUP BY 1, 2, 3",
    "asked": f"SELECT item_id AS qid, unnest(list_distinct({TERMS.format('text')})) AS term FROM benchmark",
    "lexical": "SELECT a.qid, p.document_id, p.ordinal, round(sum(p.tf) * 0.1, 6) AS score FROM asked a JOIN postings p ON p.term = a.term GROUP BY 1, 2, 3",
    "unit": "SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS vec FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)",
    "near": "SELECT b.item_id AS qid, u.vec_id, round(list_dot_product(q.vec, u.vec), 6) AS score FROM benchmark b JOIN unit q ON q.vec_id = b.item_id CROSS JOIN unit u",
    "view": "SELECT l.document_id, l.line_no AS ordinal, d.filename, l.lang AS heading, l.content FROM lines l JOIN docs d ON d.id = l.document_id AND d.status = 'ready'",
    "chunk_unit": f"SELECT document_id, ordinal, {UNIT} AS vec FROM (SELECT document_id, ordinal, {COUNTS} AS v FROM (SELECT document_id, ordinal, {PLACES.format(TERMS.format('concat_ws(chr(10) || chr(10), heading, content)'))} AS p FROM view) WHERE len(p) > 0) WHERE list_sum(list_transform(v, lambda x: abs(x))) > 0",
    "asked_unit": f"SELECT qid, {UNIT} AS vec FROM (SELECT item_id AS qid, {COUNTS} AS v FROM (SELECT item_id, {PLACES.format(TERMS.format('text'))} AS p FROM benchmark) WHERE len(p) > 0) WHERE list_sum(list_transform(v, lambda x: abs(x))) > 0",
    "near_chunks": "SELECT q.qid, u.document_id, u.ordinal, round(list_dot_product(q.vec, u.vec), 6) AS score FROM asked_unit q CROSS JOIN chunk_unit u",
    "dense_ranked": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, document_id, ordinal) AS rank FROM near_chunks) WHERE rank <= 16",
    "lexical_ranked": "SELECT * FROM (SELECT x.*, row_number() OVER (PARTITION BY qid ORDER BY score DESC, document_id, ordinal) AS rank FROM (SELECT lexical.* FROM lexical SEMI JOIN view USING (document_id, ordinal)) x) WHERE rank <= 16",
    "fused": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, document_id, ordinal) AS rank FROM (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.document_id, b.document_id) AS document_id, coalesce(a.ordinal, b.ordinal) AS ordinal, a.rank AS dense_rank, b.rank AS lexical_rank, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 9) AS score FROM dense_ranked a FULL JOIN lexical_ranked b ON a.qid = b.qid AND a.document_id = b.document_id AND a.ordinal = b.ordinal)) WHERE rank <= 8",
    "paired": f"SELECT f.qid, f.document_id, f.ordinal, v.filename, v.heading, v.content, {TERMS.format('b.text')} AS q, {TERMS.format('v.heading')} AS h, {TERMS.format('v.content')} AS c, f.score AS fused_score FROM fused f JOIN view v USING (document_id, ordinal) JOIN benchmark b ON b.item_id = f.qid",
    "scored": "SELECT qid, document_id, ordinal, filename, heading, content, fused_score, round(least(0.99::DOUBLE, (2 * len(list_distinct(list_intersect(q, h))) + len(list_distinct(list_filter(list_intersect(q, c), lambda t: NOT list_contains(h, t))))) / greatest(1.0::DOUBLE, 1.3 * len(list_distinct(q)))), 6) AS score FROM paired",
    "best": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, document_id, ordinal) AS rank FROM scored) WHERE rank <= 4",
    "gate": "SELECT b.item_id AS qid, coalesce(max(s.score) >= 0.35, false) AS evidence FROM benchmark b LEFT JOIN best s ON s.qid = b.item_id GROUP BY 1",
}
ALL_LEXICAL = "lines tokens postings asked lexical"
ALL_FUSED = f"docs {ALL_LEXICAL} view chunk_unit asked_unit near_chunks dense_ranked lexical_ranked fused"


def sql(names: str, body: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in names.split()) + ("" if body.lstrip().startswith(",") else " ") + body


@query("ix1", sql("lines tokens", "SELECT term, count(*) AS n FROM tokens GROUP BY 1"))
def ix1(spark, d) -> DataFrame:
    """Words of all chunks by the analyser that SQL repeats."""
    return R.analysed(plain_chunks(spark, d), STOP, stem=None).groupBy("term").agg(F.count("*").alias("n"))


@query("ix1_stemmed")
def ix1_stemmed(spark, d) -> DataFrame:
    """Stems of all chunks with Spanish stop words; a distinct word is stemmed once."""
    from pyspark.ml.feature import StopWordsRemover

    return R.analysed(plain_chunks(spark, d), StopWordsRemover.loadDefaultStopWords("spanish")).groupBy("term").agg(F.count("*").alias("n"))


@query("ix2", sql("lines tokens postings", "SELECT p.term, p.document_id, p.ordinal, p.tf, f.df FROM postings p JOIN (SELECT term, count(*) AS df FROM postings GROUP BY 1) f USING (term)"))
def ix2(spark, d) -> DataFrame:
    index = stored(spark, d)
    df = R.sent(index.statistics().filter("term is not null").select("term", "df"))
    return index.postings().join(df, "term").select("term", "document_id", "ordinal", "tf", "df")


#: What is left after the updates of ix2_updates: no document with a number divisible by 7.
LEFT = "left_ AS (SELECT * FROM tokens WHERE document_id % 7 <> 0), posted AS (SELECT term, document_id, ordinal, count(*) AS tf FROM left_ GROUP BY 1, 2, 3)"


@query("ix2_updates", sql("lines tokens", f", {LEFT} SELECT p.term, p.document_id, p.ordinal, p.tf, f.df FROM posted p JOIN (SELECT term, count(*) AS df FROM posted GROUP BY 1) f USING (term)"))
def ix2_updates(spark, d) -> DataFrame:
    """Postings of an index that was built from other texts, then changed, added to, made to forget, and compacted.

    Frequencies come from the stored statistics.
    """
    at, lines = folder(spark), plain_chunks(spark, d)
    old = lines.filter("document_id % 3 = 0").withColumn("content", F.reverse("content"))
    I.update(spark, at, old.unionByName(lines.filter("document_id % 3 = 1")), stop=STOP)
    I.update(spark, at, lines.filter("document_id % 3 = 0"), stop=STOP)
    I.update(spark, at, lines.filter("document_id % 3 = 2"), lines.filter("document_id % 7 = 0 and document_id % 3 < 2").select("document_id"), stop=STOP)
    I.compact(spark, at)
    I.update(spark, at, gone=lines.filter("document_id % 7 = 0").select("document_id"), stop=STOP)
    index = I.Index(spark, at)
    return index.postings().join(index.statistics().select("term", "df"), "term").select("term", "document_id", "ordinal", "tf", "df")


@query("ix3", sql("lines tokens postings asked", "SELECT a.qid, count(*) AS hits, count(DISTINCT (document_id, ordinal)) AS chunks FROM asked a JOIN postings p ON p.term = a.term GROUP BY 1"))
def ix3(spark, d) -> DataFrame:
    found = stored(spark, d).matches(questions(spark, d))
    return found.groupBy("qid").agg(F.count("*").alias("hits"), F.count_distinct("document_id", "ordinal").alias("chunks"))


@query("ix4", sql(ALL_LEXICAL, "SELECT qid, document_id, ordinal, score FROM lexical"))
def ix4(spark, d) -> DataFrame:
    return R.summed_scores(stored(spark, d).matches(questions(spark, d)))


@query("ix4_top", sql(ALL_LEXICAL, "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, document_id, ordinal) AS rank FROM lexical) WHERE rank <= 10"))
def ix4_top(spark, d) -> DataFrame:
    """The ten best chunks of each question, opening only blocks whose bound reaches the tenth score."""
    return stored(spark, d).top_k(questions(spark, d), 10)


@query("ix4_bm25", sql("lines tokens postings asked", """
, lens AS (SELECT document_id, ordinal, sum(tf) AS len FROM postings GROUP BY 1, 2), stats AS (SELECT count(*) AS n, avg(len) AS mean FROM lens),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
scores AS (SELECT a.qid, p.document_id, p.ordinal, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS score FROM asked a JOIN postings p USING (term) JOIN df USING (term) JOIN lens l ON l.document_id = p.document_id AND l.ordinal = p.ordinal CROSS JOIN stats GROUP BY 1, 2, 3)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, document_id, ordinal) AS rank FROM scores) WHERE rank <= 10"""))
def ix4_bm25(spark, d) -> DataFrame:
    """The same by BM25, with bounds from a block's highest count and shortest chunk."""
    return stored(spark, d).top_k(questions(spark, d), 10, "bm25")


@query("ix5")
def ix5(spark, d) -> DataFrame:
    """Vectors of every chunk's heading and text."""
    text = R.embedding_text(F.col("heading"), F.col("content"))
    return plain_chunks(spark, d).select(*KEY, R.embedder()(text).alias("embedding"))


@query("ix6", "WITH u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE len(embedding) = 64) SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 5) AS norm2, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first FROM u")
def ix6(spark, d) -> DataFrame:
    e = S.read(spark, d, "embeddings").filter(F.size("embedding") == 64).select("vec_id", R.doubles(F.col("embedding")).alias("v"))
    return e.select("vec_id", F.round(R.dot(F.col("v"), F.col("v")), 5).alias("norm2"), F.round(F.element_at(R.normalised(F.col("v")), 1), 6).alias("first"))


@query("ix7", sql("unit near", "SELECT qid, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM near) WHERE rank <= 10"))
def ix7(spark, d) -> DataFrame:
    return R.dense_top_k(given_questions(spark, d), vectors(spark, d), 10, ["vec_id"])


#: Folders of the approximate indexes that this process wrote, by that of the index of the same chunks.
NEAR: dict[str, str] = {}


def chunk_vectors(spark, d) -> DataFrame:
    return chunks(spark, d).select(*KEY, R.normalised(R.doubles(F.col("embedding"))).alias("vec")).filter("vec is not null")


def stored_near(spark, d) -> str:
    """The approximate index of all chunks' vectors, written once a session."""
    root = stored(spark, d).root
    if root not in NEAR:
        at = folder(spark)
        A.build(chunk_vectors(spark, d), KEY, at)
        NEAR[root] = at
    return NEAR[root]


@query("ix8")
def ix8(spark, d) -> DataFrame:
    """The ten nearest chunks of every question by the stored approximate index, beside their exact rank, from which recall follows."""
    q = questions(spark, d).select("qid", "qvec")
    exact = R.dense_top_k(q, chunk_vectors(spark, d), 10, KEY).select("qid", *KEY, F.col("rank").alias("exact_rank"))
    return exact.join(ix8_search(spark, d).select("qid", *KEY, "rank"), ["qid", *KEY], "left")


@query("ix8_search")
def ix8_search(spark, d) -> DataFrame:
    """The approximate answer alone."""
    return A.search(questions(spark, d).select("qid", "qvec"), stored_near(spark, d), KEY, 10)[0]


@query("ix8_scanned")
def ix8_scanned(spark, d) -> DataFrame:
    """How many of all chunks' codes each question met."""
    met = A.search(questions(spark, d).select("qid", "qvec"), stored_near(spark, d), KEY, 10)[1]
    return met.crossJoin(chunk_vectors(spark, d).agg(F.count("*").alias("chunks")))  # one row


@query("ix8_uniform")
def ix8_uniform(spark, d) -> DataFrame:
    """The given vectors, which hardly form lists: two thirds of them are compared for a recall of nine tenths."""
    q, v = given_questions(spark, d), vectors(spark, d)
    exact = R.dense_top_k(q, v, 10, ["vec_id"]).select("qid", "vec_id", F.col("rank").alias("exact_rank"))
    return exact.join(R.bucketed_top_k(q, v, 10, ["vec_id"]).select("qid", "vec_id", "rank"), ["qid", "vec_id"], "left")


def _branches(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    asked, docs = questions(spark, d), R.ready(S.docs(spark, d))
    view = R.retrievable(chunks(spark, d), docs)
    vecs = view.select(*KEY, R.normalised(R.doubles(F.col("embedding"))).alias("vec"))
    dense = R.dense_top_k(asked.select("qid", "qvec"), vecs, 16, KEY)
    lexical = R.lexical_top_k(asked, stored(spark, d), view, docs, 16, KEY)
    return dense, lexical, view


@query("jn13", sql(ALL_FUSED, "SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.document_id, b.document_id) AS document_id, a.rank AS dense_rank, b.rank AS lexical_rank FROM dense_ranked a FULL JOIN lexical_ranked b ON a.qid = b.qid AND a.document_id = b.document_id AND a.ordinal = b.ordinal"))
def jn13(spark, d) -> DataFrame:
    dense, lexical, _ = _branches(spark, d)
    a, b = dense.select("qid", *KEY, F.col("rank").alias("dense_rank")), lexical.select("qid", *KEY, F.col("rank").alias("lexical_rank"))
    return a.join(b, ["qid", *KEY], "full_outer").select("qid", "document_id", "dense_rank", "lexical_rank")


def _fused(spark, d) -> tuple[DataFrame, DataFrame]:
    dense, lexical, view = _branches(spark, d)
    return R.sent(R.fused(dense, lexical, KEY, 8).checkpoint()), view


@query("rt1", sql(ALL_FUSED, "SELECT qid, document_id, dense_rank, lexical_rank, score, rank FROM fused"))
def rt1(spark, d) -> DataFrame:
    return _fused(spark, d)[0].select("qid", "document_id", "dense_rank", "lexical_rank", "score", "rank")


@query("rt2", sql(ALL_FUSED, "SELECT qid, document_id, round(least(1.0, score / (2.0::DOUBLE / 61)), 6) AS score FROM fused"))
def rt2(spark, d) -> DataFrame:
    return _fused(spark, d)[0].select("qid", "document_id", F.round(R.rrf_share(F.col("score")), 6).alias("score"))


def _pairs(spark, d, fused: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Fused candidates with their texts; the few rows go to the chunks, whose texts aren't shuffled."""
    found, view = fused or _fused(spark, d)
    return found.join(view.select(*KEY, "filename", "heading", "content"), KEY).join(questions(spark, d).select("qid", "question"), "qid")


def _overlap():
    return R.overlap_score(F.col("question"), F.col("heading"), F.col("content"))


WORDS = "list_distinct(list_filter(string_split_regex(lower({}), '[\\x20\\x09-\\x0D]+'), lambda t: t <> ''))"


@query("rt3", sql(f"{ALL_FUSED} paired", f"SELECT qid, document_id, ordinal, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, document_id, ordinal) AS rank FROM (SELECT qid, document_id, ordinal, round(CAST(len(list_intersect(a, c)) AS DOUBLE) / greatest(1, len(a)), 6) AS score FROM (SELECT p.qid, p.document_id, p.ordinal, {WORDS.format('b.text')} AS a, {WORDS.format('p.content')} AS c FROM paired p JOIN benchmark b ON b.item_id = p.qid))) WHERE rank <= 4"))
def rt3(spark, d) -> DataFrame:
    """Candidates scored again by a scorer of pairs, here shared words over all, through its UDF."""

    def words(text: str) -> set[str]:
        return set(re.findall(r"[^\x20\x09-\x0D]+", text.lower()))

    def score(questions: list[str], contents: list[str]) -> list[float]:
        pairs = [(words(q), words(c)) for q, c in zip(questions, contents, strict=True)]
        return [round(len(q & c) / max(1, len(q)), 6) for q, c in pairs]

    return R.reranked(_pairs(spark, d), R.pair_scorer(score)("question", "content"), KEY, 4).select("qid", *KEY, "score", "rank")


@query("rt4", sql(f"{ALL_FUSED} paired scored", "SELECT qid, document_id, ordinal, score FROM scored"))
def rt4(spark, d) -> DataFrame:
    return _pairs(spark, d).select("qid", *KEY, _overlap().alias("score"))


def _best(spark, d, fused: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    return R.reranked(_pairs(spark, d, fused), _overlap(), KEY, 4)


@query("rt5", sql(f"{ALL_FUSED} paired scored best gate", "SELECT qid, evidence FROM gate"))
def rt5(spark, d) -> DataFrame:
    return R.evidence_gate(questions(spark, d), _best(spark, d))


@query("rt6", sql(f"{ALL_FUSED} paired scored best gate", "SELECT b.qid, b.document_id, b.score FROM best b JOIN gate g ON g.qid = b.qid AND g.evidence"))
def rt6(spark, d) -> DataFrame:
    best = _best(spark, d)
    return R.with_evidence(best, R.evidence_gate(questions(spark, d), best)).select("qid", "document_id", "score")


@query("rt7", "SELECT item_id AS qid, CASE WHEN item_id % 2 = 0 THEN 'apendicectomia: ' || text ELSE text END AS question FROM benchmark")
def rt7(spark, d) -> DataFrame:
    procedure = F.when(F.col("item_id") % 2 == 0, "apendicectomia")
    return S.read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), R.enriched(F.col("text"), procedure).alias("question"))


@query("rt8", S.with_tables("docs", "SELECT id, concat_ws(' › ', filename, CASE WHEN id % 3 > 0 THEN title END, CASE WHEN id % 2 = 0 THEN 'p. ' || (id % 50) END) AS citation FROM docs"))
def rt8(spark, d) -> DataFrame:
    heading, page = F.when(F.col("id") % 3 > 0, F.col("title")), F.when(F.col("id") % 2 == 0, F.col("id") % 50)
    return S.docs(spark, d).select("id", R.citation(F.col("filename"), heading, page).alias("citation"))


@query("rt9", sql(f"{ALL_FUSED} paired scored best gate", "SELECT b.qid, b.document_id, b.ordinal, b.rank, b.score, concat_ws(' › ', b.filename, b.heading) AS citation, b.content FROM best b JOIN gate g ON g.qid = b.qid AND g.evidence"))
def rt9(spark, d) -> DataFrame:
    """The consult pipeline for all benchmark questions."""
    return R.consult(questions(spark, d), chunks(spark, d), S.docs(spark, d), stored(spark, d))


@query("jn9", sql(ALL_FUSED, "SELECT f.qid, count(*) FILTER (f.document_id % 2 = 1) AS kept, count(*) FILTER (f.document_id % 2 = 0) AS withdrawn FROM fused f GROUP BY 1"))
def jn9(spark, d) -> DataFrame:
    """What stays of each answer once the documents with even ids have been withdrawn from the newest snapshot."""
    found, view = _fused(spark, d)
    still, gone = R.revalidated(found, view.filter("document_id % 2 = 1"), KEY)
    counts = still.groupBy("qid").agg(F.count("*").alias("kept")).join(gone, "qid", "full_outer")
    return counts.select("qid", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("withdrawn", F.lit(0)).alias("withdrawn"))


@query("rt10")
def rt10(spark, d) -> DataFrame:
    """Learn and forget: each question's answer before and after the documents of all answers are gone from the snapshot."""
    asked, docs = questions(spark, d), S.docs(spark, d)
    return E.forgetting(asked, chunks(spark, d), docs, stored(spark, d))


@query("tx12", S.with_tables("lines", "SELECT document_id, line_no AS ordinal, lang || chr(10) || chr(10) || content AS embedding_text FROM lines"))
def tx12(spark, d) -> DataFrame:
    return plain_chunks(spark, d).select("document_id", "ordinal", R.embedding_text(F.col("heading"), F.col("content")).alias("embedding_text"))

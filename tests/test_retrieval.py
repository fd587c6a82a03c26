import numpy as np
from pyspark.sql import functions as F

from tidewell.operators import evaluation as E
from tidewell.operators import retrieval as R

R_KEY = ["document_id", "ordinal"]


def test_exact_neighbours_of_more_questions_than_a_broadcast_takes(spark, monkeypatch):
    rng = np.random.default_rng(2)
    unit = lambda n: (x := rng.normal(size=(n, 8))) / np.linalg.norm(x, axis=1, keepdims=True)
    q, v = unit(45), unit(70)
    v[60:] = v[:10]  # ties, decided by number
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "qid long, qvec array<double>")
    chunks = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, vec array<double>")
    monkeypatch.setattr(R, "MOST_QUERIES", 10)
    monkeypatch.setattr(R, "CHUNK_PARTS", 5)
    got = {(r.qid, r.vec_id, r.rank) for r in R.dense_top_k(asked, chunks, 6, ["vec_id"]).collect()}
    scores = np.round(q @ v.T, 6)
    assert got == {(i, j, n) for i in range(45) for n, j in enumerate(sorted(range(70), key=lambda j: (-scores[i, j], j))[:6], 1)}


def test_forgetting_can_fail(spark):
    said = {1: "dolor agudo en la herida", 2: "fiebre alta de noche", 3: "fiebre alta de noche", 4: "nada que ver"}
    vec = lambda i: [float(k == i) for k in range(6)]
    chunks = spark.createDataFrame([(i, 0, "guia", t, vec(i)) for i, t in said.items()], "document_id long, ordinal long, heading string, content string, embedding array<float>")
    docs = spark.createDataFrame([(i, "ready", f"{i}.pdf") for i in said], "id long, status string, filename string")
    asked = spark.createDataFrame([(1, "dolor herida", vec(1)), (2, "fiebre alta", vec(2)), (3, "cosa ajena", vec(5))], "qid long, question string, qvec array<double>")
    index = R.postings(R.analysed(chunks, ["la", "en", "de"], stem=None))
    found = lambda told: {r.qid: r[1:] for r in E.forgetting(asked, chunks, docs, index, told).collect()}
    one = found(spark.createDataFrame([(1,), (2,)], "id long"))
    assert {q: (r[0], r[1], r[4], r[5]) for q, r in one.items()} == {1: (True, False, 0, True), 2: (True, True, 0, False), 3: (False, False, 0, False)}
    assert {q: (r[0], r[3], r[5]) for q, r in found(None).items()} == {1: (True, 0, True), 2: (True, 0, True), 3: (False, 0, False)}


def test_nearest_chunks_of_many_small_batches(spark):
    """Ties at the last place, rows without a vector, fewer rows than places and no questions, over batches and tasks."""
    v = [[1.0, 0.0], [0.6, 0.8], [0.0, 1.0]]
    chunks = spark.createDataFrame([(100 - i, i % 3, v[i % 3] if i % 7 else None) for i in range(90)], "document_id long, ordinal long, vec array<double>").repartition(5)
    asked = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None)], "qid string, qvec array<double>")
    rows = [(100 - i, i % 3, v[i % 3]) for i in range(90) if i % 7]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.qid, r.document_id, r.ordinal, r.score, r["rank"]) for r in R.dense_top_k(asked, chunks, 30, R_KEY).collect()}
        assert R.dense_top_k(asked.limit(0), chunks, 3, R_KEY).count() == 0 and R.dense_top_k(asked, chunks.limit(0), 3, R_KEY).count() == 0
        assert R.dense_top_k(asked, chunks, 1000, R_KEY).count() == 2 * len(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = set()
    for qid, q in (("a", v[0]), ("b", v[2])):
        ranked = sorted((-round(q[0] * x[0] + q[1] * x[1], 6), d, o) for d, o, x in rows)[:30]
        want |= {(qid, d, o, -s, n) for n, (s, d, o) in enumerate(ranked, 1)}
    assert got == want


def test_vectors_of_texts(spark):
    """Accents and case fold, words add up, and a text without words (null too) has no direction."""
    texts = spark.createDataFrame([(0, "Árbol árbol MESA"), (1, "arbol, arbol: mesa"), (2, ""), (3, None), (4, "¿?")], "n int, t string")
    found = texts.withColumn("e", R.embedder()("t")).select("n", "e", R.normalised(R.doubles(F.col("e"))).alias("u")).orderBy("n").collect()
    assert found[0].e == found[1].e and sum(map(abs, found[0].e)) in (1, 3) and abs(sum(x * x for x in found[0].u) - 1) < 1e-12
    assert all(r.u is None for r in found[2:])

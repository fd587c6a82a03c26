"""op11, op12, op13 and what stands below them, against brute force."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidewell.llm import decontamination, prefix_trie, qd, whitening
from tidewell.llm.tree import subtree_totals


def brute_totals(tree):
    up = {i: p for i, p, _ in tree}
    out = defaultdict(int)
    for i, _, v in tree:
        while i is not None:
            out[i] += v or 0
            i = up.get(i)
    return {i: out[i] for i in up}


@pytest.mark.parametrize("shape", ["chain", "star", "comb", "random", "forest", "lone", "none"])
def test_contraction_finds_every_subtree_total(spark, shape):
    rng = np.random.default_rng(3)
    tree = {
        "chain": [(i, i - 1 if i else None, i) for i in range(70)], "star": [(i, 0 if i else None, 1) for i in range(200)],
        "comb": [(i, None if i == 0 else i - 2 if i % 2 else max(i - 2, 0), 1) for i in range(60)],
        "random": [(i, int(rng.integers(i)) if i else None, None if i == 5 else int(rng.integers(9))) for i in range(300)],
        "forest": [(i, i - 1 if i % 10 else None, 2) for i in range(50)], "lone": [(7, None, 3)], "none": [],
    }[shape]
    got = subtree_totals(spark.createDataFrame(tree, "id long, parent long, v long"), ["v"]).collect()
    assert {r.id: r.v for r in got} == brute_totals(tree) and len(got) == len(tree)


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append(((t is not None, t or 0), hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    members, whole = defaultdict(list), {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    name = {p: (min(m), len(p)) for p, m in members.items()}
    out = {}
    for p, m in members.items():
        inside = [q for q in members if q[: len(p)] == p]
        kids = [q for q in inside if len(q) == len(p) + 1]
        leaf = [q for q in inside if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in members)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in inside if q)
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p))
        out[name[p]] = (name[p[:-1]][0] if p else None, len(m), len(kids), len(leaf), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


CONVERSATIONS = [
    (0, 0, "user", "hola"), (0, 1, "assistant", "ñandú"), (0, 2, "user", "adiós"), (0, 3, None, None), (0, 4, "user", "x"), (0, 5, "user", "y"), (0, 6, "user", "y"),
    (1, 0, "user", "hola"), (1, 1, "assistant", "ñandú"), (2, 1, "b", "dos"), (2, None, "b", "antes"), (2, 1, "a", "dos"), (2, 1, "a", "dos"), (3, 0, None, ""), (3, 0, "", None),
    (100, 0, "ab", "c"), (100, 1, "a", "bc"), (101, 0, "a", "bc"), (250, 0, "q", "sin base"), (-5, 1, "user", "menos"), (-5, 2, "user", "x"), (None, 1, "user", "nadie"), *((c, t, "u", f"{t}") for c in (5, 6, 7, 300) for t in range(9)),
]


def conversations_at(spark, tmp_path_factory, rows):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth long, nth string").write.parquet(f"{at}/conversations.parquet")
    return at


def trie_rows(df):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}


def test_trie_equals_brute_force(spark, tmp_path_factory, monkeypatch):
    at = conversations_at(spark, tmp_path_factory, CONVERSATIONS)
    want = brute_trie(CONVERSATIONS)
    assert trie_rows(prefix_trie.op11_tree_contraction(spark, at)) == want
    # small blocks and pieces: running sums and lists go through many of them
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 1)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 2)
    assert trie_rows(prefix_trie.op11_tree_contraction(spark, at)) == want


def test_trie_of_nothing(spark, tmp_path_factory):
    assert prefix_trie.op11_tree_contraction(spark, conversations_at(spark, tmp_path_factory, [])).count() == 0
    assert prefix_trie.op11_tree_contraction(spark, conversations_at(spark, tmp_path_factory, [(None, 1, "u", "x")])).count() == 0


def test_trie_of_one_long_conversation_and_many_copies(spark, tmp_path_factory):
    rows = [(7, t, "u", "ñ" * (t % 3)) for t in range(2500)] + [(1000 + c, t, "u", "igual") for c in range(300) for t in range(2)]
    found = trie_rows(prefix_trie.op11_tree_contraction(spark, conversations_at(spark, tmp_path_factory, rows)))
    assert found[7, 0][1] == 301 and max(d for c, d in found if c == 7) == 2500 - zlib.crc32(b"7") % 6  # conversation 0 isn't there
    deep = [found[7, d] for d in range(2, 2490)]
    assert all(n == (7, 1, 1, 1, 0, hashlib.sha256().hexdigest()) for n in deep)
    assert sum(1 for (c, d), n in found.items() if n[2] == 0) == found[7, 0][3]


WORD = re.compile(decontamination.PATTERN)


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def brute_hits(text, items, size=10):
    words, hit, found = WORD.findall(lowered(text)), set(), set()
    for item, other in items:
        theirs = WORD.findall(lowered(other))
        n = min(size, len(theirs))
        windows = {tuple(theirs[i : i + n]) for i in range(max(1, len(theirs) - size + 1))} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found |= {item} - {None}
    return words, hit, sorted(map(str, found))


LONG = " ".join(f"p{i}" for i in range(40))
ITEMS = [(1, LONG), (2, "Solo Cuatro palabras ÑANDÚ"), (3, None), (4, "..."), (None, "texto sin número aquí"), (10, " ".join(f"p{i}" for i in range(5, 20))), (10, "otra vez diez"), (11, "Solo cuatro palabras ÑANDÚ"), (12, "zz")]
TEXTS = [
    LONG, f"antes {LONG} después", " ".join(f"P{i}!" for i in range(8, 17)), " ".join(f"p{i}" for i in range(8, 18)), None, "", "...", "ZZ zz, zz", "solo (cuatro) palabras ÑANDÚ", "solo cuatro palabras ñandú", "Texto sin número aquí. Y más", "x " * 30_000 + LONG,
    " ".join(f"p{i}" for i in [*range(12), *range(3, 14)]), LONG, "otra vez diez otra vez diez",
]


def docs_of(spark, tmp_path_factory, texts):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(k // 2, t, 1, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, row long, words string, n_hit string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, items long").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_windows_equal_brute_force(spark, tmp_path_factory, monkeypatch):
    at = docs_of(spark, tmp_path_factory, TEXTS)
    want = []
    for k, t in enumerate(TEXTS):
        words, hit, items = brute_hits(t, ITEMS)
        want.append((k // 2, len(words), len(hit), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(hit)))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(decontamination.op12_ngram_scan(spark, at)) == sorted(want)
    monkeypatch.setattr(decontamination.hits, "__defaults__", (7,))  # several blocks of windows
    assert rows(decontamination.op12_ngram_scan(spark, at)) == sorted(want)


def test_windows_of_empty_tables(spark, tmp_path_factory):
    docs = spark.createDataFrame([(1, "uno dos")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in decontamination.contamination(docs, none).collect()] == [(2, 0, False)]
    assert decontamination.contamination(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_documents_and_spans_are_taken_out(spark, tmp_path_factory):
    at = docs_of(spark, tmp_path_factory, TEXTS)
    docs, items = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/benchmark.parquet")
    kept = decontamination.decontaminated(docs, items)
    assert kept.columns == docs.columns
    clean = [t for t in TEXTS if not brute_hits(t, ITEMS)[1]]
    assert sorted(str(r.text) for r in kept.collect()) == sorted(map(str, clean))
    cut = decontamination.decontaminated(docs, items, "spans").collect()
    assert len(cut) == len(TEXTS)

    def left(text):
        words, hit, _ = brute_hits(text, ITEMS)
        return [w for i, w in enumerate(words) if i not in hit]

    assert sorted(" ".join(WORD.findall(lowered(r.text))) for r in cut) == sorted(" ".join(left(t)) for t in TEXTS)
    assert "antes  después" in {r.text for r in cut} and ". Y más" in {r.text for r in cut}


def spread(v, sizes, rng):
    return (np.linalg.qr(rng.normal(size=(v, v)))[0] * sizes) @ np.linalg.qr(rng.normal(size=(v, v)))[0]


@pytest.mark.parametrize("size", [1, 2, 3, 8, 64, 130])
def test_singular_directions(size):
    rng = np.random.default_rng(size)
    cases = [rng.normal(size=(size, size)), np.eye(size), np.diag(np.arange(size, 0, -1.0)), np.ones((size, size)), spread(size, np.geomspace(1, 1e-13, size), rng), spread(size, np.where(np.arange(size) < 3, 5.0, 1.0), rng)]
    for r in cases:
        squares, v = qd.right_singular(r, 8, size)
        s = np.linalg.svd(r, compute_uv=False)
        k = len(squares)
        assert k == min(8, np.linalg.matrix_rank(r, tol=1e-14 * s[0]))
        assert np.allclose(squares, s[:k] ** 2, rtol=1e-12, atol=1e-14 * s[0] ** 2)
        assert np.abs(v.T @ v - np.eye(k)).max() < 1e-9
        assert np.abs(r.T @ (r @ v) - v * squares).max() < 1e-12 * s[0] ** 2
    assert len(qd.right_singular(np.zeros((size, size)), 8, 5)[0]) == 0


def embeddings(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string, n string")


def check_whitened(df, rows):
    kept = [(i, v) for i, v, *_ in rows if v is not None and len(v) == 12 and all(x is not None and np.isfinite(x) for x in v)]
    x = np.floor(np.array([v for _, v in kept], np.float32).astype(float) * 1024) + 100000
    n, c = len(x), x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    got = df.collect()
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, k) for i, _ in kept for k in range(1, 9))
    table = defaultdict(list)
    for r in got:
        table[r.component].append((r.vec_id, r.whitened, r.deviation))
        assert r.n == n and r.identity_error < 1e-9 and abs(r.explained / (values[r.component - 1] / (c**2).sum() * n) - 1) < 1e-10
    order = sorted(range(n), key=lambda i: (kept[i][0], *x[i]))
    want = (c @ vectors / np.sqrt(values))[order]
    sums = [int(s) for s in x.sum(axis=0)]
    exact = sorted((kept[i][0], sum((int(a) * n - s) ** 2 for a, s in zip(x[i], sums, strict=True))) for i in range(n))
    for k in range(8):
        assert sorted((i, d) for i, _, d in table[k + 1]) == exact
        mine = sorted((i, w) for i, w, _ in table[k + 1])
        theirs = [sorted((kept[i][0], s * w) for i, w in zip(order, want[:, k], strict=True)) for s in (1, -1)]
        assert min(max(abs(a[1] - b[1]) for a, b in zip(mine, t, strict=True)) for t in theirs) < 1e-8


def test_whitening_equals_an_eigen_solver(spark, monkeypatch):
    rng = np.random.default_rng(5)
    good = [(i, [float(v) for v in rng.normal(size=12) * np.arange(1, 13)], "x", "y") for i in range(150)]
    bad = [(900, None, "", ""), (901, [], "", ""), (902, [float("nan")] * 12, "", ""), (903, [1.0] * 11 + [None], "", ""), (904, [1.0] * 11 + [float("-inf")], "", ""), (905, [1.0] * 7, "", "")]
    rows = good + bad + [good[3], good[3]]
    df = embeddings(spark, rows).repartition(7)
    check_whitened(whitening.whitened(df), rows)
    monkeypatch.setattr(whitening, "FAN_IN", 2)  # triangles and moments meet in several rounds
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 5)
    check_whitened(whitening.whitened(df), rows)


def test_whitening_without_spread(spark):
    assert whitening.whitened(embeddings(spark, [])).count() == 0
    assert whitening.whitened(embeddings(spark, [(1, None, "", ""), (2, [], "", "")])).count() == 0
    assert whitening.whitened(embeddings(spark, [(k, [0.5, 1.5], "", "") for k in range(4)])).count() == 0
    line = whitening.whitened(embeddings(spark, [(k, [float(k), 2.0 * k, 1.0], "", "") for k in range(4)])).collect()
    assert [r.component for r in line] == [1] * 4 and all(abs(r.explained - 1) < 1e-12 for r in line)


def test_deviation_beyond_a_long():
    x = np.array([[2**53, 0], [100000, 100000]])
    n, sums = 2, [int(s) for s in x.sum(axis=0)]
    assert whitening.deviations(x, n, sums) == [None, None]
    assert whitening.deviations(x // 2**30, n, [int(s) for s in (x // 2**30).sum(axis=0)]) == [8388608**2] * 2

"""The operators against brute force on nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import functools
import hashlib
import random
import re
import string
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from tests.llm.conftest import EDGE, WORDS, extra
from tidewell.llm import bpe, catalog, fingerprint, kneser_ney, line_dedup, mixing, quality_rules, simhash, token_files, tokens, warc
from tidewell.llm.common import table

Q = catalog.queries()
TEXTS = [(r[0], r[1] or "") for r in EDGE]


def by_id(rows, key="doc_id"):
    return Counter(tuple(r) for r in rows)


@pytest.mark.parametrize("name", [n for n in Q])
def test_empty_tables_give_empty_results(spark, empty, name):
    assert Q[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", [n for n in Q if n not in ("op4_segment_reassembly", "pipeline")])
def test_every_row_comes_back(spark, edge, name):
    ids = [r.doc_id for r in Q[name](spark, edge).select("doc_id").collect()]
    assert Counter(ids) == Counter(r[0] for r in EDGE)


def test_mixture_meets_its_targets(spark, edge, folder):
    rows = Q["op1_golden_schedule"](spark, edge).collect()
    size = Counter()
    for (_, text, _, source, *_), n in zip(EDGE, (len((r[1] or "").encode().split()) for r in EDGE), strict=True):
        size[source] += n
    order = sorted((s for s in size if s is not None)) + [None]
    left, total, target = {s: 1 + i % 3 for i, s in enumerate(order)}, sum(size.values()), {}
    while left:  # targets by filling up round by round
        share = (total - sum(target.values())) / sum(left.values())
        over = [s for s in left if share * left[s] > 3 * size[s]]
        if not over:
            target |= {s: share * w for s, w in left.items()}
            break
        for s in over:
            target[s] = 3.0 * size[s]
            del left[s]
    got = {(r.source_size, round(r.target, 6)) for r in rows}
    assert got == {(size[s], round(target[s], 6)) for s in order}
    taken = Counter()
    for r in rows:
        taken[(r.source_size, round(r.target, 6))] += r.taken
        assert r.taken <= 3 * r["size"]
    assert all(abs(taken[k] - k[1]) <= 1 for k in got)
    again = Q["op1_golden_schedule"](spark, edge).collect()
    assert by_id(rows) == by_id(again)


def test_bpe_is_the_librarys_and_decodes(spark, edge):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.ranks_path(), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t in TEXTS:
        ids = enc.encode_ordinary(t)
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert by_id(Q["op2_recursive_merges"](spark, edge).collect()) == want
    words = bpe.Words(ranks, public_tokenizers.PATTERN)
    rng = random.Random(4)
    long = ["".join(rng.choices(string.ascii_lowercase, k=n)).encode() for n in [500] * 40 + [5_000]] + [b"aabbaabb" * 200, "ñandú".encode() * 300]
    assert [x.tolist() for x in words.merged(long)] == [enc._encode_single_piece(w) for w in long]


def test_merges_are_literal_whatever_the_vocabulary():
    """Ranks in any order, so that a merge may make a pair of lesser rank."""

    def literal(word, ranks):
        parts = [word[i : i + 1] for i in range(len(word))]
        while found := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    rng = random.Random(7)
    for size in (0, 8, 20, 60):
        tokens = list({"".join(rng.choices("abc", k=rng.randint(2, 5))).encode() for _ in range(size)})
        rng.shuffle(tokens)
        ranks = {bytes([i]): i for i in range(256)} | {t: 256 + k for k, t in enumerate(tokens)}
        given = ["".join(rng.choices("abc", k=rng.randint(1, 40))).encode() for _ in range(150)]
        assert [x.tolist() for x in bpe.Words(ranks, public_tokenizers.PATTERN).merged(given)] == [literal(w, ranks) for w in given]


def test_chunks_are_cut_where_the_library_cuts(library):
    """Odd spaces, special tokens, marks and a slice's bounds."""
    texts = ["", " ", "a  b", "x <|endoftext|> y z", None, " lead\n two", "ñ ¿qué? “a b”  \n c ", "\u00a0 a \u2003 b\x1c c", "\u3000 x" * 5] + [WORDS] * 3
    encoder = tokens.library_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for some in (texts, texts[::-1], texts[:1], [None]):
        ids, at = encoder(pa.array(some, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode(t or "", add_special_tokens=False).ids for t in some]

def model_by_brute_force(counts):
    """Probability of an n-gram under the model of these counts of ORDER-grams, from the definition."""
    n = kneser_ney.ORDER
    levels = {n: dict(counts)}
    for k in range(n - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    after = {k: defaultdict(list) for k in levels}
    for k, level in levels.items():
        for g, v in level.items():
            after[k][g[:-1]].append(v)

    def discounts(level):
        c = Counter(level.values())
        n1, n2, n3, n4 = (c[i] for i in (1, 2, 3, 4))
        if not n1 or not n2:
            return (0.5, 0.75, 0.9)
        y = n1 / (n1 + 2 * n2)
        raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
        return tuple(min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1))

    ds = {k: discounts(v) for k, v in levels.items()}

    @functools.cache
    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / (1 + len(levels[1]))
        seen = after[k].get(gram[:-1])
        if not seen:
            return p(gram[1:])
        own = levels[k].get(gram, 0)
        cut = ds[k][min(own, 3) - 1] if own else 0
        left = sum(ds[k][min(v, 3) - 1] for v in seen) / sum(seen)
        return max(own - cut, 0) / sum(seen) + left * p(gram[1:])

    return p


def character_grams(text):
    n = kneser_ney.ORDER
    text = kneser_ney.PAD + " ".join((text or "").split()) + kneser_ney.END
    return [text[i : i + n] for i in range(len(text) - n + 1)]


def test_kneser_ney_probabilities_sum_to_one_and_match_brute_force(spark):
    assert kneser_ney.ORDER == 5
    counts = Counter(character_grams("abracadabra abre la cabra"))
    # every n-gram whose context is seen, so that probabilities of a context can be added up
    alphabet = sorted({g[-1] for g in counts})
    grams = {g[:-1] + c for g in counts for c in alphabet}
    df = spark.createDataFrame([(g, counts[g]) for g in grams], "gram string, n long")
    got = {r.gram: np.exp(r.log_p) for r in kneser_ney.probabilities(df).collect()}
    p = model_by_brute_force(counts)
    assert all(abs(got[g] - p(g)) < 1e-12 for g in grams)
    sums = Counter()
    for g in grams:
        sums[g[:-1]] += got[g]
    assert all(0.5 < x < 1.0 + 1e-9 for x in sums.values())  # the rest is the unseen characters'


@pytest.mark.parametrize("piece", [1 << 16, 40])
def test_perplexities_and_verdicts_against_brute_force(spark, folder, monkeypatch, piece):
    """Also with texts of many pieces, blocks of few rows, a language too rare for a threshold of its own, nulls and repeated rows."""
    monkeypatch.setattr(kneser_ney, "PIECE", piece)
    monkeypatch.setattr(kneser_ney, "BLOCK_BITS", 5)
    monkeypatch.setattr(kneser_ney, "SUPPORT", 4)
    monkeypatch.setattr(kneser_ney, "SLICE", 2_000)
    rng = random.Random(2)
    stock = "el la casa perro gato corre salta verde rojo cielo mar tierra y en con sobre".split()
    rows = [extra(i, " ".join(rng.choices(stock, k=rng.choice((3, 30, 300)))), ("es", "fr", "xx")[(i > 80) + (i > 145)]) for i in range(150)]
    rows += [extra(200 + i, "".join(rng.choices("#%&qzx ", k=120)), "es") for i in range(10)] + [extra(300, None, None), extra(301, ""), extra(5, "otra fila"), extra(None, "sin número")]
    labels = [(i, 1, 0) for i in range(150) if i % 4] + [(5, 0, 0), (201, 0, 0), (None, 1, 0)]
    found = Q["op3_kneser_ney"](spark, folder(rows, labels)).collect()
    ids = sorted({i for i, q, _ in labels if q == 1 and i is not None})
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    held = {r.doc_id for r in df.filter(f"pmod(xxhash64(doc_id), {kneser_ney.HELD_OUT}) = 0").collect()}
    role = {i: 2 if i in held else 1 for i in ids}
    p = model_by_brute_force(Counter(g for r in rows if role.get(r[0]) == 1 for g in character_grams(r[1])))
    want, calibration = [], []
    for i, text, lang, *_ in rows:
        logs = [np.log(p(g)) for g in character_grams(text)]
        want.append((i, lang, np.exp(-np.mean(logs))))
        if role.get(i) == 2:
            calibration.append((lang, want[-1][2]))

    def quantile(values):  # the least value with so many values up to it
        return sorted(values)[int(np.ceil(kneser_ney.QUANTILE * len(values))) - 1]

    threshold = {lang: quantile([x for own, x in calibration if own == lang]) for lang, n in Counter(own for own, _ in calibration).items() if n >= 4}
    assert "es" in threshold and "xx" not in threshold
    every = quantile([x for _, x in calibration])

    def key(r):
        return (r[0] is None, r[0] or 0, r[2])

    assert len(found) == len(want)
    for r, (i, lang, x) in zip(sorted(found, key=lambda r: key((r.doc_id, r.lang, r.perplexity))), sorted(want, key=key), strict=True):
        limit = kneser_ney.MARGIN * threshold.get(lang, every)
        assert (r.doc_id, r.lang, r.kept) == (i, lang, x <= limit)
        assert abs(r.perplexity - x) < 1e-4 * x and abs(r.threshold - limit) < 1e-4 * limit


def test_classifier_tells_junk_from_prose(spark, folder):
    rng = np.random.default_rng(1)
    vocabulary = "el la casa perro gato corre salta verde rojo cielo mar tierra y en con sobre".split()
    prose = [extra(i, " ".join(rng.choice(vocabulary, 80))) for i in range(120)]
    junk = [extra(1000 + i, " ".join("#" + w[::-1].upper() + "%" for w in rng.choice(vocabulary, 80))) for i in range(20)]
    at = folder(prose + junk, [(i, 1, 0) for i in range(0, 120, 2)] + [(1000 + i, 0, 0) for i in range(5)])
    kept = {r.doc_id for r in Q["op3_kneser_ney"](spark, at).collect() if r.kept}
    assert len(kept & set(range(120))) >= 118 and not kept & set(range(1000, 1020))


def test_warc_round_trip(spark, edge, tmp_path):
    rows = [(1, "<p>" + "ñ" * 9000 + "</p>"), (2, ""), (3, "corto"), (4, "corto"), (None, "z" * 200), (6, "z" * 200), (6, "z" * 200), (7, "")]
    got = Q["op4_segment_reassembly"](spark, edge).collect()
    want = Counter((p, len(h.encode()), hashlib.sha256(h.encode()).hexdigest()) for p, h in rows)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == want
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kinds == Counter({(1, "response", None): 1, (2, "response", None): 1, (3, "response", None): 1, (4, "response", None): 1, (6, "response", None): 1, (6, "revisit", 6): 1, (None, "revisit", 6): 1, (7, "response", None): 1})
    assert warc.dechunked(warc.chunked(b"abc" * 5000)) == b"abc" * 5000
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nab")
    path = warc.write_archive(table(spark, edge, "pages"), str(tmp_path / "w"))
    assert warc.records(spark, path, segmented=True).filter("kind = 'continuation'").count() > 0
    lost = warc.records(spark, path, segmented=True).filter("number != 2")
    with pytest.raises(Exception, match="not complete"):
        warc.reassembled(lost).collect()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts_and_their_cache(spark, edge, library, tmp_path):
    from tidewell.llm import token_counts

    want = Counter((i, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in TEXTS)
    cache = str(tmp_path / "cache")
    for _ in range(2):
        assert by_id(token_counts.counted(table(spark, edge, "documents"), cache, token_counts.tokenizer_path()).collect()) == want
        assert spark.read.parquet(cache).count() == len({t for _, t in TEXTS})  # the second time nothing is encoded


def test_token_files(spark, edge, library):
    docs = sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0))
    at, want = 0, Counter()
    for i, t in docs:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want[(i, at, len(ids), zlib.crc32(ids.tobytes()))] += 1
        at += len(ids)
    assert by_id(Q["op6_zstd_dictionary"](spark, edge).collect()) == want


def test_one_document_is_read_by_its_frame(spark, edge, library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "RANGE_DOCS", 4)
    path = token_files.write_shards(table(spark, edge, "documents").select("doc_id", "text"), str(tmp_path / "t"), token_files.tokenizer_path())
    for i in (1, 2, 3, 7, 12):
        want = [[*library.encode(t, add_special_tokens=False).ids, 0] for k, t in TEXTS if k == i]
        assert token_files.read_document(spark, path, i) == want
    assert token_files.read_document(spark, path, 999) == []


def test_a_wrong_dictionary_is_noticed(spark, edge, tmp_path):
    path = token_files.write_shards(table(spark, edge, "documents").select("doc_id", "text"), str(tmp_path / "t"), token_files.tokenizer_path())
    name = spark.read.parquet(f"{path}/dictionary").first().dictionary
    spark.createDataFrame([(name, b"other")], "dictionary string, raw binary").write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(Exception, match="dictionary"):
        token_files.read_documents(spark, path, lambda i, s, x: (i, s), "doc_id long, start long").collect()


PASSAGE = "Este pasaje se repite en muchos documentos y tiene bastantes palabras para que no sea casualidad alguna."


def shortest_runs(lines):
    """Every run of lines with enough words that has too few without its first line, or without its last."""
    least, found = line_dedup.MIN_WORDS, []
    for i in range(len(lines)):
        for j in range(i + 1, len(lines) + 1):
            n = [len(w) for _, w in lines[i:j]]
            if sum(n) >= least and (sum(n[1:]) < least or sum(n[:-1]) < least):
                found.append((i, j - i, tuple(" ".join(w) for _, w in lines[i:j])))
    return found


def longest_rising(v):
    """Places of a longest rising run of different numbers; of several, the one with the least numbers from its end on."""
    size, prev = [], []
    for i, x in enumerate(v):
        size.append(1 + max((size[j] for j in range(i) if v[j] < x), default=0))
        prev.append(min((j for j in range(i) if size[j] == size[i] - 1 and v[j] < x), key=lambda j: v[j], default=None))
    i = min((i for i in range(len(v)) if size[i] == max(size)), key=lambda i: v[i], default=None)
    out = []
    while i is not None:
        out.append(i)
        i = prev[i]
    return out[::-1]


def patience_by_brute_force(a, b, i=0, j=0):
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(i, j), *patience_by_brute_force(a[1:], b[1:], i + 1, j + 1)]
    if a[-1] == b[-1]:
        return [*patience_by_brute_force(a[:-1], b[:-1], i, j), (i + len(a) - 1, j + len(b) - 1)]
    once = [x for x in a if a.count(x) == 1 and b.count(x) == 1]
    kept = [once[k] for k in longest_rising([b.index(x) for x in once])]
    out, p, q = [], 0, 0
    for x in kept:
        p_x, q_x = a.index(x), b.index(x)
        out += [*patience_by_brute_force(a[p:p_x], b[q:q_x], i + p, j + q), (i + p_x, j + q_x)]
        p, q = p_x + 1, q_x + 1
    return out + (patience_by_brute_force(a[p:], b[q:], i + p, j + q) if kept else [])


def lost_by_alignment(texts):
    """Raw positions of the lines that each text loses, by an alignment with every earlier text."""
    lines = [[(p, x.split()) for p, x in enumerate((t or "").split("\n")) if x.split()] for t in texts]
    runs, out = [sorted(shortest_runs(ls)) for ls in lines], []
    for d, ls in enumerate(lines):
        gone = set()
        for e in range(d):
            both = {x[2] for x in runs[d]} & {x[2] for x in runs[e]}
            a, b = ([x for x in runs[k] if x[2] in both] for k in (d, e))
            pairs = patience_by_brute_force([x[2] for x in a], [x[2] for x in b])
            own = {k for i, _ in pairs for k in range(a[i][0], a[i][0] + a[i][1])}
            left, offset = [], None
            for i, (at, n, x) in enumerate(a):
                if i in {i for i, _ in pairs} or set(range(at, at + n)) <= own:
                    continue
                places = [y[0] for y in b if y[2] == x]
                e_at = at - offset if offset is not None and at - offset in places else places[0]
                if left and offset == at - e_at and at <= max(left[-1]) + 1:
                    left[-1] |= set(range(at, at + n))
                else:
                    left.append(set(range(at, at + n)))
                offset = at - e_at
            gone |= own.union(*(x for x in left if sum(len(ls[k][1]) for k in x) >= line_dedup.MOVED_WORDS))
        out.append({ls[k][0] for k in gone})
    return out


def deduplicated(texts):
    return [None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone) for t, gone in zip(texts, lost_by_alignment(texts), strict=True)]


def test_line_dedup_deletes_from_later_documents(spark, folder):
    rows = [extra(5, "uno propio\n" + PASSAGE + "\nfin cinco"), extra(1, "inicio de verdad\n" + PASSAGE + "\n\nsí"), extra(3, PASSAGE + "\n" + PASSAGE), extra(4, "sí\nno"), extra(None, PASSAGE)]
    got = {r.doc_id: r for r in Q["op7_patience_alignment"](spark, folder(rows)).collect()}
    assert got[1].text == "inicio de verdad\n" + PASSAGE + "\n\nsí"
    assert got[3].text == "" and got[3].earlier_ids == [1]  # both occurrences stand in an earlier document
    assert got[5].text == "uno propio\nfin cinco" and got[5].lines_removed == 1
    assert got[4].text == "sí\nno"  # a short line alone is no passage
    assert got[None].text == ""


def test_line_dedup_finds_blocks_whose_lines_have_other_first_holders(spark, folder):
    first, second = "aa bb cc\n" + "\n".join(f"x{i}" for i in range(7)), "aa bb cc\ndd ee ff"
    got = {r.doc_id: r.text for r in Q["op7_patience_alignment"](spark, folder([extra(1, first), extra(2, second), extra(3, second)])).collect()}
    assert got == {1: first, 2: second, 3: ""}


def test_line_dedup_against_brute_force(spark, folder, monkeypatch):
    """Random texts of few lines, moved and repeated blocks, copies, blank lines, a line that half of the texts hold."""
    monkeypatch.setattr(line_dedup, "FREQUENT", 10_000)
    monkeypatch.setattr(line_dedup, "NEAREST", 10_000)  # every holder is paired
    rng = random.Random(11)
    stock = [" ".join(rng.choices("ab cd ef gh ij".split(), k=rng.choice((1, 1, 2, 3, 6, 9)))) for _ in range(40)] + ["", "  "]
    texts = ["\n".join(rng.choices(stock, k=rng.randint(0, 14))) for _ in range(150)]
    texts += [t if k % 3 else t + "\nuna línea que está en la mitad de los textos" for k, t in enumerate(rng.choices(texts, k=90))] + [None]
    got = {r.doc_id: r.text for r in Q["op7_patience_alignment"](spark, folder([extra(i, t) for i, t in enumerate(texts)])).collect()}
    assert got == dict(enumerate(deduplicated(texts)))


@pytest.mark.parametrize(("frequent", "rows"), [(2, line_dedup.BROADCAST_ROWS), (6, 0)])
def test_line_dedup_leaves_out_no_partner(spark, folder, monkeypatch, frequent, rows):
    """The same as an alignment with every earlier text, however few holders are met at first."""
    monkeypatch.setattr(line_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(line_dedup, "NEAREST", 1)
    rng = random.Random(12)
    stock = [" ".join(rng.choices("ab cd ef gh ij".split(), k=rng.choice((1, 2, 3, 6, 9)))) for _ in range(14)] + [""]
    texts = ["\n".join(rng.choices(stock, k=rng.randint(0, 9))) for _ in range(120)]
    # the line's first holder and the nearest ones hold another line in the other order, only one between aligns it
    one, two = "la primera línea tiene seis palabras", "la segunda también tiene seis palabras"
    texts += [f"{one}\npropio {k}\n{two}" if k != 4 else two for k in range(9)] + [f"{two}\nfin\n{one}"]
    got = {r.doc_id: r.text for r in Q["op7_patience_alignment"](spark, folder([extra(i, t) for i, t in enumerate(texts)])).collect()}
    want = dict(enumerate(deduplicated(texts)))
    assert got == want and got[len(texts) - 1] == "fin"


@pytest.mark.parametrize(("rows", "moved"), [(line_dedup.BROADCAST_ROWS, 15), (0, 15), (0, 10_000)])
def test_line_dedup_of_frequent_passages(spark, folder, monkeypatch, rows, moved):
    """A passage of many holders goes from all but the first, whether or not the frequent ones are broadcast."""
    monkeypatch.setattr(line_dedup, "FREQUENT", 4)
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(line_dedup, "MOVED_WORDS", moved)
    got = {r.doc_id: r for r in Q["op7_patience_alignment"](spark, folder([extra(i, f"propio {i}\n{PASSAGE}\nfin {i}") for i in range(300)])).collect()}
    assert got[0].lines_removed == 0
    assert all(got[i].text == f"propio {i}\nfin {i}" and got[i].earlier_ids == [0] for i in range(1, 300))


def test_line_dedup_is_an_alignment_and_no_hash_rule(spark, folder):
    """Two short lines in another order: one is aligned, the other stays; a moved passage of many words goes."""
    one, two = "la primera línea tiene seis palabras", "la segunda también tiene seis palabras"
    rows = [extra(1, f"{one}\nnada\n{two}"), extra(2, f"{two}\notra cosa\n{one}"), extra(3, f"{PASSAGE}\n{one}"), extra(4, f"{one}\nalgo\n{PASSAGE}")]
    got = {r.doc_id: r.text for r in Q["op7_patience_alignment"](spark, folder(rows)).collect()}
    assert got[2] in (f"{two}\notra cosa", f"otra cosa\n{one}")
    assert got[3] == PASSAGE and got[4] == "algo"


def test_line_dedup_of_many_lines(spark, folder):
    lines = [f"línea número {i} de un texto muy largo" for i in range(100_000)]
    rows = [extra(1, "\n".join(lines)), extra(2, "\n".join(lines[50_000:] + ["algo nuevo"] + lines[:50_000])), extra(3, "\n".join(lines[:300][::-1]))]
    got = {r.doc_id: r for r in Q["op7_patience_alignment"](spark, folder(rows)).collect()}
    assert got[1].lines_removed == 0 and got[2].text == "algo nuevo"
    assert got[3].lines_removed == 1  # in falling order one line is aligned, and none of the moved ones is long enough


def test_patience_alignment():
    assert line_dedup.increasing([3, 1, 2, 5, 4]) == [1, 2, 4]
    assert line_dedup.patience([1, 2, 3, 4], [3, 1, 2, 4]) == [(0, 1), (1, 2), (3, 3)]
    rng = random.Random(5)
    for _ in range(2_000):
        a, b = (rng.choices(range(12), k=rng.randint(0, 12)) for _ in "ab")
        assert line_dedup.patience(a, b) == patience_by_brute_force(a, b)


def test_rule_statistics(spark, edge):
    want = Counter()
    for i, t in TEXTS:
        w = [x.decode() for x in t.encode().split()]
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        twice = Counter(windows)
        covered = {p for k, x in enumerate(windows) if twice[x] > 1 for p in range(k, k + 5)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        want[(i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed)] += 1
    got = Q["op8_decision_list"](spark, edge).collect()
    assert Counter(tuple(r)[:7] for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)


def test_rules_are_learned_on_held_out_accuracy():
    rng = np.random.default_rng(0)
    cells = Counter()
    for k in range(3000):
        a, b = rng.integers(0, 10, 2)
        bad = a >= 7 and b < 4
        cells[((int(a), int(b)), k % 3 == 0, bad)] += 1
    table_ = [(c, h, cells[(c, h, True)], cells[(c, h, False)]) for c, h in sorted({(c, h) for c, h, _ in cells})]
    rules = quality_rules.learn({"a": [float(i) for i in range(1, 10)], "b": [float(i) for i in range(1, 10)]}, table_)
    assert [sorted((c.feature, c.value, c.above) for c in r) for r in rules] == [[("a", 7.0, True), ("b", 4.0, False)]]
    assert quality_rules.learn({"a": [1.0]}, [((0,), False, 0, 5)]) == []


def canonical(t):
    t = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", t).casefold())
    return re.sub(r"[^\S\x1c-\x1f]+", " ", unicodedata.normalize("NFKD", t)).strip(" ")  # the four separators below 0x20 aren't white space


def test_canonical_form_and_edited_texts(spark, edge):
    docs = table(spark, edge, "documents")
    got = {r.t: r.c for r in docs.select(docs.text.alias("t"), fingerprint.canonical(docs.text).alias("c")).collect() if r.t is not None}
    for t, c in got.items():
        assert c == canonical(t), t[:60]
    rows = Q["op9_canonical_digest"](spark, edge).collect()
    order = sorted(range(len(TEXTS)), key=lambda k: (TEXTS[k][0] is None, -(TEXTS[k][0] or 0)))
    want = Counter()
    for at, k in enumerate(order):
        text, nxt = TEXTS[k][1], TEXTS[order[(at + 1) % len(order)]][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        want[(TEXTS[k][0], len(text), hashlib.sha256(edited.encode()).hexdigest())] += 1
    assert Counter(tuple(r)[:3] for r in rows) == want
    nine, ten = (next(r.fingerprint for r in rows if r.doc_id == i) for i in (9, 10))
    assert nine == ten
    assert len({r.fingerprint for r in rows}) == len({canonical(t) for _, t in TEXTS})


def brute(fps):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in np.nonzero(np.bitwise_count(fps ^ fps[i]) <= simhash.RADIUS)[0]:
            a, b = root[i], root[j]
            if a != b:
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_simhash_components(spark, edge):
    def fp(t):
        w = t.encode().lower().split()
        parts = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in parts]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    texts = [(i, t) for i, t in TEXTS if len(t) < 100_000]
    fps = np.array([fp(t) for _, t in texts], np.uint64)
    root = brute(fps)
    least = {r: min((texts[k][0] for k in range(len(texts)) if root[k] == r and texts[k][0] is not None), default=None) for r in set(root)}
    want = Counter((texts[k][0], f"{int(fps[k]):016x}", least[root[k]]) for k in range(len(texts)))
    got = Counter(tuple(r) for r in Q["op10_vantage_points"](spark, edge).filter("doc_id is null or doc_id != 7").collect())
    assert got == want


@pytest.mark.parametrize("depth_rows", [40_000, 60])
def test_vantage_points_lose_no_link(spark, monkeypatch, depth_rows):
    """Clusters around random centres, chains within the radius, and a dense ball."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", depth_rows)
    monkeypatch.setattr(simhash, "LEAF", 256)
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    fps = [*centres]
    for c in centres[:60]:
        x = c
        for _ in range(5):
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                x = x ^ np.uint64(1 << int(b))
            fps.append(x)
    fps += [centres[0] ^ np.uint64((1 << i) | (1 << j)) for i in range(12) for j in range(i)]
    fps = np.unique(np.array(fps, np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").checkpoint()
    from tidewell.llm.graph import components

    got = {r.node: r.root for r in components(simhash.links(df)).collect()}
    signed = [int(x) for x in fps.view(np.int64)]
    root = brute(fps)
    want = {}
    for r in set(root):
        members = [signed[k] for k in range(len(fps)) if root[k] == r]
        want |= {m: min(members) for m in members}
    assert {s: got.get(s, s) for s in signed} == want


@pytest.mark.parametrize("few", [32, 2])
def test_near_dedup_stage_links_by_shingles(spark, folder, monkeypatch, few):
    """Edited copies at similarity 0.8 and more go, others stay, as a comparison of all pairs says."""
    import corpus_pipeline
    from tidewell.llm import near_copies

    monkeypatch.setattr(near_copies, "FEW", few)
    monkeypatch.setattr(near_copies, "GROUP", 5)  # several parts of a key
    monkeypatch.setattr(near_copies, "OPEN_GROUP", 5)
    rng = np.random.default_rng(5)
    vocabulary = np.array([f"palabra{i}" for i in range(900)])
    texts = []
    for n in (8, 12, 60, 60, 61, 150, 400, 400):
        base = [*rng.choice(vocabulary, n)]
        texts.append(base)
        for k in (1, 2, 3, 5, 8, 13):
            copy = [*base]
            for at in rng.choice(n, min(k, n // 4), replace=False):
                copy[at] = "otra" + copy[at]
            texts += [copy, copy + [*rng.choice(vocabulary, k)]]
    texts = [" ".join(t) for t in texts] + ["", None, "una dos", "una dos"]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    root = list(range(len(texts)))
    edited = 0
    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                edited += x != sets[j] and (simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() > simhash.RADIUS
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    assert edited > 20
    rows = [extra(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, table(spark, folder(rows), "documents"), "").collect()}
    assert got == set(root)


@pytest.mark.parametrize("crossing", [False, True])
def test_near_dedup_searches_by_vantage_points(monkeypatch, crossing):
    """A shard's candidates are those of all pairs, and groups of near copies aren't compared with each other."""
    from tidewell.llm import near_copies

    rng, compared, close = np.random.default_rng(8), [], near_copies.close
    monkeypatch.setattr(near_copies, "close", lambda a, b: compared.append(len(a) * len(b)) or close(a, b))
    bits = np.repeat(rng.integers(0, 2, (6, 256), np.uint8), 250, axis=0) ^ (rng.random((1500, 256)) < rng.choice((0.01, 0.03, 0.06), (1500, 1)))
    bits = np.concatenate((bits, rng.integers(0, 2, (100, 256), np.uint8)))[rng.permutation(1600)]
    fp = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    size = np.sort(rng.integers(90, 120, 1600))
    rows = pd.DataFrame({"size": size, "group": rng.integers(0, 1000, 1600), "side": np.arange(1600) % 2 if crossing else 0} | {c: fp[:, k].view(np.int64) for k, c in enumerate(near_copies.PRINT)})
    got = [tuple(x) for block in near_copies.near_blocks(rows, crossing) for x in block.T.tolist()]
    d = np.bitwise_count(fp[:, None] ^ fp[None, :])
    near = (d.sum(axis=2, dtype=int) <= near_copies.RADIUS) & (d[:, :, 0] <= near_copies.FIRST) & (rows.group.values[:, None] != rows.group.values) & (5 * np.minimum(size[:, None], size) >= 4 * np.maximum(size[:, None], size))
    own = (rows.side.values[:, None] == 0) & (rows.side.values == 1) if crossing else np.triu(np.ones_like(near), 1)
    want = {(i, j, d[i, j].sum(dtype=int)) for i, j in np.argwhere(near & own)}
    assert Counter((*((i, j) if crossing else sorted((i, j))), b) for i, j, b in got) == Counter(want)
    assert sum(compared) < own.sum() / 2


def test_stages_keep_columns_they_don_t_know(spark, edge):
    import corpus_pipeline

    docs = table(spark, edge, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, edge)
        assert out.schema == docs.schema or [f.name for f in out.schema] == docs.columns, name
        assert {(r.row, r.fp, r["size"], r.doc, r["_row"]) for r in out.collect()} == {(7, "x", "y", "z", "w")}, name


def test_pipeline_against_a_plain_run(spark, edge):
    """The stages one by one, each checked by its own means above, give what run() gives."""
    import corpus_pipeline

    docs = table(spark, edge, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, edge)
    assert by_id(docs.collect()) == by_id(corpus_pipeline.run(spark, edge).collect())


def test_mixed_documents_are_whole(spark, folder):
    rows = [extra(i, "palabra " * (20 + i), source="ab"[i % 2]) for i in range(40)] + [extra(99, None, source="a")]
    docs = table(spark, folder(rows), "documents")
    out = mixing.repeated(docs).collect()
    assert {r.text for r in out} <= {r[1] for r in rows} and 99 in {r.doc_id for r in out}
    words = Counter()
    for r in out:
        words[r.source] += len((r.text or "").split())
    assert abs(words["b"] / words["a"] - 2) < 0.2

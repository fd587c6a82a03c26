from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import layout
from tidewell.streaming.stateful import sentence_pieces


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("r")).first().r


def test_normalisation(spark):
    assert one(spark, "ﬁn\r\nA​B\x07 ½ ﻿x\ty", T.normalised) == "fin\nAB 1⁄2 x\ty"
    assert one(spark, None, T.normalised) is None


def test_sections_know_their_path(spark):
    md = "intro\n# A\nuno\n## B\ndos\n### C\ntres\n## D\n\n# E\ncuatro"
    got = [(r.heading, r.body) for r in T.sections(rows(spark, [(1, md)], "document_id long, markdown string")).orderBy("section").collect()]
    assert got == [(None, "intro"), ("A", "uno"), ("A › B", "dos"), ("A › B › C", "tres"), ("E", "cuatro")]


def test_packing_keeps_sentences_whole_and_overlaps(spark):
    text = " ".join(f"La frase número {i} dice algo." for i in range(40))
    pieces = one(spark, text, lambda c: T.packed_sentences(c, 200, 50))
    assert all(len(p) <= 200 for p in pieces) and len(pieces) > 5
    assert pieces[1].split(".")[0] in pieces[0]
    assert one(spark, "x" * 500, lambda c: T.packed_sentences(c, 200, 50)) == ["x" * 500]


LONG = "texto " * 30


def test_short_sections_join_kin_only():
    assert T.merged_sections([("A", LONG), ("A › B", "corto")]) == [("A", LONG + "\n\nB\ncorto")]
    assert T.merged_sections([("A", "corto"), ("A › B", LONG)]) == [("A › B", "corto\n\n" + LONG)]
    assert T.merged_sections([("A › B", "corto"), ("A › C", LONG)]) == [("A › B", "corto"), ("A › C", LONG)]
    assert T.merged_sections([("A", LONG), ("B", "corto")]) == [("A", LONG), ("B", "corto")]
    assert T.merged_sections([("A", LONG), ("B", "corto")], strict_kin=False) == [("A", LONG + "\n\ncorto")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([None, "A", "A › B", "A › C", "D"]), st.sampled_from(["corto", "breve", LONG])), max_size=8))
def test_merging_loses_no_text(sections):
    out = T.merged_sections(sections)
    assert sum(b.count("corto") + b.count("breve") + b.count("texto") for _, b in out) == sum(b.count("corto") + b.count("breve") + b.count("texto") for _, b in sections)


def test_chunk_ordinals_are_dense(spark):
    md = "# A\n" + LONG + "\n## B\n" + LONG * 10
    got = [r.ordinal for r in T.chunked(rows(spark, [(1, md), (2, "")], "document_id long, markdown string")).orderBy("ordinal").collect()]
    assert got == list(range(len(got))) and len(got) >= 2


def test_pages_from_a_moving_cursor(spark):
    body = "alfa " * 30
    docs = rows(spark, [(1, body + body, [0, 120])], "document_id long, markdown string, page_starts array<int>")
    chunks = rows(spark, [(1, 0, body.strip()), (1, 1, "no está")], "document_id long, ordinal long, content string")
    assert [(r.ordinal, r.page) for r in T.with_pages(chunks, docs).orderBy("ordinal").collect()] == [(0, 1), (1, None)]


def test_spoken_sentences(spark):
    f = T.spoken_sentences
    assert one(spark, "La fiebre es de 38.5 grados hoy. Llame a la dra. Gómez mañana. ¿Está bien?", f) == ["La fiebre es de 38.5 grados hoy.", "Llame a la dra. Gómez mañana.", "¿Está bien?"]
    assert one(spark, "Bien. Muchas gracias por contarlo.", f) == ["Bien. Muchas gracias por contarlo."]
    assert one(spark, "Pesa unos 70 kg. Después lo vemos todo.", f) == ["Pesa unos 70 kg.", "Después lo vemos todo."]


def test_streamed_sentences_keep_their_space():
    split = lambda s: [x for x in s.strip().split(". ") if x]
    assert sentence_pieces("uno. dos ", split) == (["uno"], "dos ")


def test_layout(spark):
    lines = rows(spark, [(1, 0, 0, "una pala-"), (1, 0, 1, "bra y"), (1, 0, 2, ""), (1, 0, 3, "fin")], "document_id long, block int, line_no int, text string")
    assert layout.paragraphs(lines).first().paragraph == "una palabra y fin"
    cells = rows(spark, [(1, 1, 0, ["a", "b"]), (1, 1, 1, ["c"])], "document_id long, table_id int, row_no int, cells array<string>")
    assert layout.markdown_table(cells).first().markdown == "| a | b |\n| --- | --- |\n| c |  |"
    heads = rows(spark, [(1, 0, 1, "Guía de"), (1, 1, 1, "alta"), (1, 2, None, "texto"), (1, 3, 2, "x" * 111)], "document_id long, line_no int, level int, text string")
    assert [(r.line_no, r.level, r.text) for r in layout.merged_headings(heads).orderBy("line_no").collect()] == [(0, 1, "Guía de alta"), (2, None, "texto"), (3, None, "x" * 111)]


def test_heading_accuracy_aligns_titles_in_order(spark):
    kind = "document_id long, pos long, title string, level long"
    expected = [(1, 1, "Ficha – Uno", 1), (1, 2, "Dos", 2), (1, 3, "Tres", 2), (1, 4, "Dos", 3), (1, 5, "Cinco", 2), (2, 1, "Solo", 1)]
    extracted = [(1, 10, "ﬁcha - uno", 2), (1, 20, "  TRES ", 3), (1, 30, "dos", 3), (1, 40, "dos", 5), (3, 1, "Solo", 1)]
    got = T.heading_accuracy(spark.createDataFrame(extracted, kind), spark.createDataFrame(expected, kind))
    rows = {(r.document_id, r.pos): (r.found, r.in_order, r.level_ok) for r in got.collect()}
    # titles by place: 10, 30, 20, 40; two longest runs of three, of which the one with the lesser ends is kept
    assert rows == {(1, 1): (True, True, True), (1, 2): (True, False, True), (1, 3): (True, True, True), (1, 4): (True, True, False), (1, 5): (False, False, False), (2, 1): (False, False, False)}
    empty = T.heading_accuracy(spark.createDataFrame([], kind), spark.createDataFrame(expected, kind))
    assert empty.filter("found or in_order or level_ok").count() == 0 and empty.count() == 6

"""Text preparation over the documents table; Markdown structure is made of source, language and text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import layout
from tidewell.plans import standins as S
from tidewell.plans.registry import query


def markdown(spark, d) -> DataFrame:
    """Each document under headings of its source and language, and with a section for each paragraph after the first."""
    paragraphs = F.split("text", "\n")
    rest = F.array_join(F.transform(F.slice(paragraphs, 2, F.size(paragraphs)), lambda p, i: F.concat(F.lit("### part "), i.cast("string"), F.lit("\n"), p)), "\n")
    head = F.concat(F.lit("# "), F.col("source"), F.lit("\n## "), F.col("lang"), F.lit("\n"), F.get(paragraphs, 0))
    return S.read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.when(F.size(paragraphs) > 1, F.concat(head, F.lit("\n"), rest)).otherwise(head).alias("markdown"))


PARAGRAPHS = "paragraphs AS (SELECT doc_id AS document_id, source, lang, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"


@query("tx1", "SELECT doc_id AS id, regexp_replace(replace(replace(nfc_normalize(text), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x{9F}\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}]', '', 'g') AS text FROM documents")
def tx1(spark, d) -> DataFrame:
    """Normalised text; in these documents NFKC and the SQL's NFC agree."""
    return S.read(spark, d, "documents").select(F.col("doc_id").alias("id"), T.normalised(F.col("text")).alias("text"))


@query("tx2", S.with_tables("docs", "SELECT id, CASE WHEN length(trim(text)) = 0 THEN 'empty' WHEN id % 4 > 0 AND length(trim(text)) < greatest(200, 120 * (1 + id % 9)) THEN 'no text layer' END AS reason FROM docs"))
def tx2(spark, d) -> DataFrame:
    return S.docs(spark, d).select("id", T.text_layer_reason(F.col("text"), 1 + F.col("id") % 9, F.col("id") % 4 == 0).alias("reason"))


@query("tx3", "SELECT doc_id AS document_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ') AS paragraph FROM documents")
def tx3(spark, d) -> DataFrame:
    """Lines of each document as one paragraph; these have no hyphens at line ends (the tests have)."""
    rows = S.lines(spark, d).select("document_id", F.lit(0).alias("block"), "line_no", F.col("content").alias("text"))
    return layout.paragraphs(rows).select("document_id", "paragraph")


BLOCKS = "blocks AS (SELECT document_id, line_no % 3 AS page, line_no, (line_no * 37) % 500 + 0.0 AS x0, (line_no * 37) % 500 + 80.0 AS x1, (length(content) * 7) % 700 + 0.0 AS y0, (length(content) * 7) % 700 + 12.0 AS y1 FROM lines)"


@query("tx4", S.with_tables("lines", f", {BLOCKS} SELECT document_id, line_no FROM blocks b WHERE NOT ((x0 + x1) / 2 BETWEEN 100 AND 300 AND (y0 + y1) / 2 BETWEEN 50 + document_id % 100 AND 350 + document_id % 100 AND page = 1)"))
def tx4(spark, d) -> DataFrame:
    """Blocks on a made page grid outside the one table of each document's second page."""
    n, k = F.col("line_no"), F.length("content")
    blocks = S.lines(spark, d).select("document_id", (n % 3).alias("page"), "line_no", ((n * 37) % 500 + 0.0).alias("x0"), ((n * 37) % 500 + 80.0).alias("x1"), ((k * 7) % 700 + 0.0).alias("y0"), ((k * 7) % 700 + 12.0).alias("y1"))
    tables = S.docs(spark, d).select(F.col("id").alias("document_id"), F.lit(1).cast("long").alias("page"), F.lit(100.0).alias("tx0"), (50 + F.col("id") % 100).alias("ty0"), F.lit(300.0).alias("tx1"), (350 + F.col("id") % 100).alias("ty1"))
    return layout.outside_tables(blocks, tables).select("document_id", "line_no")


LEVEL = "CASE WHEN length(content) <= 110 THEN CASE WHEN length(content) % 3 = 0 THEN 1 WHEN length(content) % 3 = 1 THEN 2 END END"


@query("tx5", S.with_tables("lines", f"""
, l AS (SELECT document_id, line_no, content, {LEVEL} AS level FROM lines), m AS (SELECT *, CASE WHEN level IS NULL OR lag(level) OVER w IS NULL OR level <> lag(level) OVER w THEN 1 ELSE 0 END AS new FROM l WINDOW w AS (PARTITION BY document_id ORDER BY line_no)),
g AS (SELECT *, sum(new) OVER (PARTITION BY document_id ORDER BY line_no) AS island FROM m) SELECT document_id, min(line_no) AS line_no, any_value(level) AS level, string_agg(trim(content), ' ' ORDER BY line_no) AS text FROM g GROUP BY document_id, island"""))
def tx5(spark, d) -> DataFrame:
    k = F.length("content")
    rows = S.lines(spark, d).select("document_id", "line_no", F.when(k % 3 == 0, 1).when(k % 3 == 1, 2).alias("level"), F.col("content").alias("text"))
    return layout.merged_headings(rows)


@query("tx6", S.with_tables("lines", """
, c AS (SELECT document_id, line_no, string_split(trim(regexp_replace(content, '\\s+', ' ', 'g')), ' | ') AS cells FROM lines), w AS (SELECT document_id, max(len(cells)) AS width, count(*) AS n FROM c GROUP BY 1),
r AS (SELECT c.document_id, line_no, '| ' || array_to_string(list_concat(list_transform(cells, lambda x: trim(x)), list_transform(range(width - len(cells)), lambda x: '')), ' | ') || ' |' AS line, '| ' || array_to_string(list_transform(range(width), lambda x: '---'), ' | ') || ' |' AS rule FROM c JOIN w USING (document_id))
SELECT document_id, string_agg(CASE WHEN line_no = 0 THEN line || chr(10) || rule ELSE line END, chr(10) ORDER BY line_no) AS markdown FROM r GROUP BY 1"""))
def tx6(spark, d) -> DataFrame:
    """Every document's lines as rows of a table, cut at bars."""
    cells = F.split(F.trim(F.regexp_replace("content", r"\s+", " ")), r" \| ")
    return layout.markdown_table(S.lines(spark, d).select("document_id", F.lit(0).alias("table_id"), F.col("line_no").alias("row_no"), cells.alias("cells"))).select("document_id", "markdown")


@query("tx7", "SELECT doc_id AS document_id, 2 + len(string_split(text, chr(10))) - 1 AS headings FROM documents")
def tx7(spark, d) -> DataFrame:
    return markdown(spark, d).select("document_id", T.heading_count(F.col("markdown")).cast("long").alias("headings"))


@query("tx8", f"WITH {PARAGRAPHS} SELECT document_id, source || ' › ' || lang || CASE WHEN i > 1 THEN ' › part ' || (i - 2) ELSE '' END AS heading, regexp_replace(p, '^\\s+|\\s+$', '', 'g') AS body FROM paragraphs WHERE regexp_replace(p, '^\\s+|\\s+$', '', 'g') <> ''")
def tx8(spark, d) -> DataFrame:
    return T.sections(markdown(spark, d)).select("document_id", "heading", "body")


@query("tx9")
def tx9(spark, d) -> DataFrame:
    """Long texts as packed sentences with overlap."""
    return S.read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(T.packed_sentences(F.col("text"))).alias("piece", "content"))


@query("tx10")
def tx10(spark, d) -> DataFrame:
    return T.merged(T.sections(markdown(spark, d)))


@query("tx11", S.with_tables("lines", "SELECT document_id, line_no AS ordinal, count(*) OVER (PARTITION BY document_id) AS n FROM lines"))
def tx11(spark, d) -> DataFrame:
    from pyspark.sql import Window

    return S.lines(spark, d).select("document_id", F.col("line_no").alias("ordinal"), F.count("*").over(Window.partitionBy("document_id")).alias("n"))


@query("tx11_chunks")
def tx11_chunks(spark, d) -> DataFrame:
    """Chunks of every document with dense ordinals: sections, merging, packing."""
    return T.chunked(markdown(spark, d))


@query("tx13")
def tx13(spark, d) -> DataFrame:
    """Page of every chunk, with a page begun every 3,000 characters."""
    docs = markdown(spark, d).withColumn("page_starts", F.sequence(F.lit(0), F.length("markdown"), F.lit(3000)))
    return T.with_pages(T.chunked(docs), docs).select("document_id", "ordinal", "page")


@query("tx14")
def tx14(spark, d) -> DataFrame:
    """Spoken sentences of every turn of the agent."""
    return S.turns(spark, d).filter("role = 'agent'").select("id", F.posexplode(T.spoken_sentences(F.regexp_replace("content", r"\s+", " "))).alias("nth", "sentence"))


#: Lines of each document as a page sets them: its number in the size of a heading before each paragraph but the first, and in
#: that of the body before each fifth, where the layout hides it; numbers of 7 more than a multiple of 10 are set after the next.
SET_LINES = """set_lines AS (SELECT document_id, 2 * i AS line_no, p AS text, 10.0 AS size FROM paragraphs UNION ALL
SELECT document_id, CASE WHEN i % 10 = 7 THEN 2 * i + 3 ELSE 2 * i - 1 END, 'ﬁle – Part ' || i, CASE WHEN i % 5 = 4 THEN 10.0 WHEN i % 3 = 0 THEN 16.0 ELSE 13.0 END FROM paragraphs WHERE i > 1)"""
EXPECTED_TITLE = "'file - part ' || i"


@query("tx15", f"""WITH {PARAGRAPHS}, {SET_LINES},
sizes AS (SELECT document_id, size, sum(length(trim(text))) AS n FROM set_lines GROUP BY 1, 2), body AS (SELECT document_id, arg_max(size, n * 1000 - size) AS body FROM sizes GROUP BY 1),
levels AS (SELECT s.document_id, s.size, dense_rank() OVER (PARTITION BY s.document_id ORDER BY s.size DESC) AS level FROM sizes s JOIN body b ON b.document_id = s.document_id AND s.size >= b.body + 0.6),
marked AS (SELECT l.document_id, line_no, text, CASE WHEN length(text) <= 110 THEN level END AS level FROM set_lines l LEFT JOIN levels v ON v.document_id = l.document_id AND v.size = l.size),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY document_id ORDER BY line_no) AS island FROM (SELECT *, CASE WHEN level IS NULL OR lag(level) OVER w IS NULL OR level <> lag(level) OVER w THEN 1 ELSE 0 END AS fresh FROM marked WINDOW w AS (PARTITION BY document_id ORDER BY line_no))),
merged AS (SELECT document_id, any_value(level) AS level, string_agg(trim(text), ' ' ORDER BY line_no) AS text FROM islands GROUP BY document_id, island HAVING any_value(level) IS NOT NULL),
got AS (SELECT document_id, replace(replace(lower(text), 'ﬁ', 'fi'), '–', '-') AS title, level - min(level) OVER (PARTITION BY document_id) AS depth FROM merged),
want AS (SELECT document_id, {EXPECTED_TITLE} AS title, lvl - min(lvl) OVER (PARTITION BY document_id) AS depth FROM (SELECT document_id, i, CASE WHEN i % 3 = 0 THEN 1 ELSE 2 END AS lvl FROM paragraphs WHERE i > 1))
SELECT w.document_id, count(*) AS expected, count(g.title) AS found, count(*) FILTER (g.depth = w.depth) AS level_ok FROM want w LEFT JOIN got g USING (document_id, title) GROUP BY 1""")
def tx15(spark, d) -> DataFrame:
    """Headings that the layout gives (body size, levels, lines merged) against the expected one of every paragraph but the first."""
    i, size = F.col("i"), F.lit(10.0)
    paragraphs = S.lines(spark, d).select("document_id", (F.col("line_no") + 1).alias("i"), F.col("content").alias("text"))
    later = paragraphs.filter(i > 1)
    heads = later.select("document_id", F.when(i % 10 == 7, 2 * i + 3).otherwise(2 * i - 1).alias("line_no"), F.concat(F.lit("ﬁle – Part "), i.cast("string")).alias("text"), F.when(i % 5 == 4, size).when(i % 3 == 0, 16.0).otherwise(13.0).alias("font_size"))
    spans = paragraphs.select("document_id", (2 * i).alias("line_no"), "text", size.alias("font_size")).unionByName(heads)
    levels = layout.heading_levels(spans)
    marked = spans.join(levels.withColumnRenamed("size", "font_size"), ["document_id", "font_size"], "left")
    extracted = layout.merged_headings(marked.select("document_id", "line_no", "level", "text")).filter("level is not null").select("document_id", F.col("line_no").alias("pos"), F.col("text").alias("title"), "level")
    expected = later.select("document_id", i.alias("pos"), F.concat(F.lit("file - part "), i.cast("string")).alias("title"), F.when(i % 3 == 0, 1).otherwise(2).cast("long").alias("level"))
    return T.heading_accuracy(extracted, expected).groupBy("document_id").agg(F.count("*").alias("expected"), F.count_if("found").alias("found"), F.count_if("level_ok").alias("level_ok"))

"""Structure from laid-out text: body size, heading levels, paragraphs, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points that a heading is larger than the body, and levels at most.
HEADING_STEP, LEVELS = 0.6, 6
LONGEST_HEADING = 110


def _grid(size: Column) -> Column:
    return F.round(size * 2) / 2


def _sizes(spans: DataFrame) -> DataFrame:
    return spans.groupBy("document_id", _grid(F.col("font_size")).alias("size")).agg(F.sum(F.length(F.trim("text"))).alias("n"))


def body_size(spans: DataFrame) -> DataFrame:
    """Size on the half-point grid that most characters of a document have; the smaller one on a tie."""
    return _sizes(spans).groupBy("document_id").agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("body_size"))


def heading_levels(spans: DataFrame) -> DataFrame:
    """Sizes above the body's as levels 1 (largest) to LEVELS."""
    sizes = _sizes(spans).select("document_id", "size").join(body_size(spans), "document_id").filter(F.col("size") >= F.col("body_size") + HEADING_STEP)
    level = F.dense_rank().over(Window.partitionBy("document_id").orderBy(F.desc("size")))
    return sizes.select("document_id", "size", level.cast("long").alias("level")).filter(F.col("level") <= LEVELS)


def rebuilt_paragraph(lines: Column) -> Column:
    """Lines of a block as one paragraph: a hyphen at a line's end goes when the next begins in lower case; blank lines are skipped."""
    kept = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")

    def add(acc: Column, line: Column) -> Column:
        broken = F.rlike(acc, F.lit(r"\p{L}-$")) & F.rlike(line, F.lit(r"^\p{Ll}"))
        return F.when(acc == "", line).when(broken, F.concat(F.regexp_replace(acc, "-$", ""), line)).otherwise(F.concat(acc, F.lit(" "), line))

    return F.aggregate(kept, F.lit(""), add)


def paragraphs(lines: DataFrame) -> DataFrame:
    """One row a block of lines (document_id, block, line_no, text)."""
    ordered = lines.groupBy("document_id", "block").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    return ordered.select("document_id", "block", rebuilt_paragraph(F.transform("l", lambda x: x.text)).alias("paragraph"))


def outside_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """blocks (document_id, page, x0, y0, x1, y1, ...) whose centre is in no table box (document_id, page, tx0, ty0, tx1, ty1)."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    b, t = blocks.alias("b"), tables.alias("t")
    inside = (x >= F.col("tx0")) & (x <= F.col("tx1")) & (y >= F.col("ty0")) & (y <= F.col("ty1"))
    return b.join(t, (F.col("b.document_id") == F.col("t.document_id")) & (F.col("b.page") == F.col("t.page")) & inside, "left_anti")


def merged_headings(lines: DataFrame) -> DataFrame:
    """Adjacent heading lines (document_id, line_no, level, text) of one level as one heading; level null is body text.

    A line that would make the heading longer than LONGEST_HEADING isn't a heading.
    """
    w = Window.partitionBy("document_id").orderBy("line_no")
    level = F.when(F.length("text") <= LONGEST_HEADING, F.col("level"))
    marked = lines.withColumn("level", level)
    fresh = F.col("level").isNull() | F.lag("level").over(w).isNull() | (F.col("level") != F.lag("level").over(w))
    grouped = marked.withColumn("_new", fresh.cast("int")).withColumn("_island", F.sum("_new").over(w))
    joined = grouped.groupBy("document_id", "_island").agg(F.min("line_no").alias("line_no"), F.first("level").alias("level"), F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    return joined.select("document_id", "line_no", "level", F.array_join(F.transform("l", lambda x: F.trim(x.text)), " ").alias("text"))


def markdown_table(cells: DataFrame) -> DataFrame:
    """A Markdown table for each (document_id, table_id) of rows (row_no, cells array<string>), padded to the widest row."""
    rows = cells.groupBy("document_id", "table_id").agg(F.sort_array(F.collect_list(F.struct("row_no", "cells"))).alias("r"), F.max(F.size("cells")).alias("width"))
    width = F.col("width")

    def line(cell_values: Column) -> Column:
        padded = F.concat(F.transform(cell_values, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))), F.array_repeat(F.lit(""), width - F.size(cell_values)))
        return F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))

    body = F.transform("r", lambda x: line(x.cells))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return rows.select("document_id", "table_id", F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, 2, F.size(body))), "\n").alias("markdown"))

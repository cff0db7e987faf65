"""Layout tables: characters to lines, lines to Markdown blocks, cells to Markdown tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import strip


def layout_chars_to_lines(chars: DataFrame) -> DataFrame:
    """(doc_id, page, top, x0, size, fontname, text) -> one row per visual line.

    A page is bounded, so it is the window partition; a hot document spreads over its pages.
    """
    order = ["top", "x0"]
    w = Window.partitionBy("doc_id", "page").orderBy(*order)
    marked = chars.withColumn("_prev_top", F.lag("top").over(w)).withColumn(
        "_prev_size", F.lag("size").over(w)).withColumn(
        "_new", F.coalesce((F.abs(F.col("top") - F.col("_prev_top"))
                            >= F.greatest("_prev_size", "size") * 0.5).cast("int"), F.lit(0)))
    lines = marked.withColumn("line_no", F.sum("_new").over(w)).withColumn(
        "_pos", F.row_number().over(w))
    visible = F.trim("text") != ""
    return lines.groupBy("doc_id", "page", "line_no").agg(
        strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "text"))),
                                       lambda c: c["text"]), "")).alias("text"),
        F.coalesce(F.max(F.when(visible, F.col("size"))), F.lit(12.0)).alias("max_size"),
        F.coalesce(F.min(F.when(visible, F.lower("fontname").contains("bold"))), F.lit(True))
        .alias("all_bold"))


def classify_layout_lines(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, page, line_no, text, max_size, all_bold) -> Markdown blocks.

    The body size is the most frequent size of the document; ties go to the size that comes first.
    Paragraph lines in a row on one page are joined by spaces.
    """
    size = F.round("max_size", 1)
    per_size = lines.filter(F.col("max_size").between(8, 24)).groupBy("doc_id", size.alias("size")).agg(
        F.count("*").alias("n"), F.min(F.struct("page", "line_no")).alias("first"))
    body = per_size.groupBy("doc_id").agg(
        F.min_by("size", F.struct(-F.col("n"), F.col("first"))).alias("body_size"))
    text = strip("text")
    ratio = F.col("max_size") / F.coalesce("body_size", F.lit(12.0))
    bullet, number = text.rlike(r"\A[•\-*]\s+"), text.rlike(r"\A\d+[.)]\s+")
    level = F.when(ratio >= 1.8, 1).when(ratio >= 1.4, 2).when(ratio >= 1.15, 3).otherwise(0)
    kind = (F.when(text == "", "blank").when(bullet | number, "list").when(level > 0, "heading")
            .when(F.col("all_bold") & (F.length(text) < 50), "bold").otherwise("text"))
    marked = lines.join(body, "doc_id", "left").select(
        "doc_id", "page", "line_no", kind.alias("kind"),
        F.when(kind == "list", F.regexp_replace(text, r"\A[•\-*]\s+", "- "))
        .when(kind == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text))
        .when(kind == "bold", F.concat(F.lit("## "), text)).otherwise(text).alias("block"))
    w = Window.partitionBy("doc_id", "page").orderBy("line_no")
    starts = (F.col("kind") != "text") | (F.coalesce(F.lag("kind").over(w), F.lit("")) != "text")
    return marked.withColumn("_start", starts.cast("int")).withColumn(
        "block_no", F.sum("_start").over(w)).filter("kind <> 'blank'").groupBy(
        "doc_id", "page", "block_no").agg(
        F.first("kind").alias("kind"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "block"))),
                                 lambda b: b["block"]), " ").alias("markdown"))


def render_markdown_table(cells: DataFrame) -> DataFrame:
    """Cells (table_id, row_no, col_no, text) -> one Markdown table row per row, ragged rows padded."""
    clean = strip(F.coalesce(F.col("text"), F.lit("")))
    rows = cells.groupBy("table_id", "row_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("col_no", clean.alias("t")))),
                    lambda c: c["t"]).alias("cells"))
    width = rows.groupBy("table_id").agg(F.max(F.size("cells")).alias("width"),
                                         F.min("row_no").alias("first_row"))
    joined = rows.join(width, "table_id")
    padded = F.concat(F.col("cells"), F.array_repeat(F.lit(""), F.col("width") - F.size("cells")))
    line = F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("width")), " | "), F.lit(" |"))
    return joined.select("table_id", "row_no", F.when(
        F.col("row_no") == F.col("first_row"), F.concat(line, F.lit("\n"), rule)).otherwise(line).alias("line"))

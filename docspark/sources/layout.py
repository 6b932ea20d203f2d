"""Text spans and table cells of laid-out pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_SIZE = 10.0
HEADING_FACTOR = 1.25
BOLD = 2


def base_sizes(spans: DataFrame) -> DataFrame:
    """The size most characters of a document have; the first seen size wins a tie (SRC10)."""
    place = F.struct("page", "block", "line", "span")
    per = spans.groupBy("doc", F.round(F.coalesce("size", F.lit(DEFAULT_SIZE)), 1).alias("size")).agg(
        F.sum(F.char_length("text")).alias("chars"), F.min(place).alias("seen")
    )
    first_chars = F.max(F.struct("chars")).alias("m")
    top = per.groupBy("doc").agg(first_chars)
    tied = per.join(top, "doc").where(F.col("chars") == F.col("m.chars"))
    return tied.groupBy("doc").agg(F.min_by("size", "seen").alias("base_size"))


def mark_headings(spans: DataFrame) -> DataFrame:
    """Adds base_size and is_heading to spans that hold text."""
    bold = F.col("flags").bitwiseAND(BOLD) != 0
    big = F.col("size") >= F.col("base_size") * HEADING_FACTOR
    return (
        spans.join(base_sizes(spans), "doc")
        .withColumn("text", F.trim("text"))
        .where(F.col("text") != "")
        .withColumn("is_heading", big | ((F.col("size") > F.col("base_size")) & bold))
    )


def page_texts(spans: DataFrame) -> DataFrame:
    """(doc, page, page_text, headings) of spans in reading order (SRC10).

    Spans gather per line, lines per block, blocks per page; a page is the largest group.
    """
    s = mark_headings(spans)
    shown = F.when(F.col("is_heading"), F.concat(F.lit("\n## "), "text", F.lit("\n"))).otherwise(F.col("text"))
    s = s.withColumn("shown", shown)
    lines = s.groupBy("doc", "page", "block", "line").agg(
        F.sort_array(F.collect_list(F.struct("span", "shown"))).alias("p"),
        F.count(F.when(F.col("is_heading"), 1)).alias("headings"),
        F.min(F.struct(F.round("y0", 1).alias("y"), F.round("x0", 1).alias("x"))).alias("at"),
    )
    lines = lines.withColumn("line_text", F.array_join(F.transform("p", lambda e: e["shown"]), " "))
    blocks = lines.groupBy("doc", "page", "block").agg(
        F.sort_array(F.collect_list(F.struct("line", "line_text"))).alias("p"), F.sum("headings").alias("headings"),
        F.min("at").alias("at"),
    )
    blocks = blocks.withColumn("block_text", F.array_join(F.transform("p", lambda e: e["line_text"]), "\n"))
    pages = blocks.groupBy("doc", "page").agg(
        F.sort_array(F.collect_list(F.struct("at", "block", "block_text"))).alias("p"), F.sum("headings").alias("headings")
    )
    body = F.array_join(F.transform("p", lambda e: e["block_text"]), "\n\n")
    head = F.concat(F.lit("--- PAGE "), F.col("page").cast("string"), F.lit(" ---\n"))
    return pages.select("doc", "page", F.concat(head, body).alias("page_text"), "headings")


def document_texts(pages: DataFrame) -> DataFrame:
    """Pages joined in order: one row per document."""
    g = pages.groupBy("doc").agg(
        F.sort_array(F.collect_list(F.struct("page", "page_text"))).alias("p"), F.sum("headings").alias("headings")
    )
    return g.select("doc", F.array_join(F.transform("p", lambda e: e["page_text"]), "\n\n").alias("raw_text"),
                    F.size("p").alias("page_count"), "headings")


def tables_markdown(cells: DataFrame) -> DataFrame:
    """Markdown and shape of every table of (doc, page, table, row, col, text) (SRC11)."""
    clean = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" "))
    rows = cells.groupBy("doc", "page", "table", "row").agg(
        F.sort_array(F.collect_list(F.struct("col", clean.alias("t")))).alias("c")
    )
    md = F.concat(F.lit("| "), F.array_join(F.transform("c", lambda e: e["t"]), " | "), F.lit(" |"))
    rows = rows.select("doc", "page", "table", "row", F.size("c").alias("cols"), md.alias("md"),
                       F.array_join(F.transform("c", lambda e: e["t"]), "|").alias("names"))
    t = rows.groupBy("doc", "page", "table").agg(F.sort_array(F.collect_list(F.struct("row", "md", "cols", "names"))).alias("r"))
    lines = F.transform("r", lambda e: e["md"])
    width = F.get("r", F.lit(0))["cols"]
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    with_rule = F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size("r") - 1, F.lit(0))))
    body = F.when(F.size("r") > 1, with_rule).otherwise(lines)
    return t.select(
        "doc", "page", "table", F.size("r").alias("row_count"), width.alias("col_count"),
        F.get("r", F.lit(0))["names"].alias("headers"), F.array_join(body, "\n").alias("markdown"),
    )

"""Tables out of pages: a curriculum page by its words and rules, any other page by the tables found on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import layout, tables

# Years in their order, headers and title of their tables.
YEARS = ["First Year", "Second Year", "Third Year", "Fourth Year", "Fifth Year"]
CURRICULUM_HEADERS, CURRICULUM_TITLE = ["Term", "Course #", "Course Title", "Credit Hours"], "Proposed Sequence of Study"
TABLE = ["page", "table_index", "table_id", "type", "title", "year", "year_credit_hours", "headers", "rows", "text", "notes", "bbox"]
NO_NOTES, NO_BOX = "cast(array() as array<string>)", "cast(null as array<double>)"


def curriculum_tables(words: DataFrame, rects: DataFrame, sizes: DataFrame) -> DataFrame:
    """A table for each year of a curriculum page, by year, height and side; ids keep the order on the page."""
    page_text = layout.line_texts(layout.words_in_lines(words)).groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ").alias("t"))
    listed = page_text.where(layout.is_curriculum_page(F.col("t"))).select("page")
    found = layout.curriculum_blocks(words.join(listed, "page", "left_semi"), rects.join(listed, "page", "left_semi"), sizes)
    on_page = Window.partitionBy("page").orderBy("heading_top", "panel")
    by_year = Window.partitionBy("page").orderBy(F.coalesce(F.nullif(F.array_position(tables.strings(YEARS), F.col("year")), F.lit(0)), F.lit(99)), "heading_top", "panel")
    found = found.withColumn("number", F.row_number().over(on_page)).withColumn("table_index", F.row_number().over(by_year) - 1)
    return found.select(
        F.col("page").cast("long").alias("page"), F.col("table_index").cast("int").alias("table_index"), F.concat(F.lit("page_"), F.col("page").cast("string"), F.lit("_curriculum_"), F.col("number").cast("string")).alias("table_id"),
        F.lit("curriculum").alias("type"), F.lit(CURRICULUM_TITLE).alias("title"), "year", F.col("credit_hours").cast("int").alias("year_credit_hours"), tables.strings(CURRICULUM_HEADERS).alias("headers"), "rows",
        tables.curriculum_text(F.col("page"), F.col("year"), F.col("rows")).alias("text"), F.expr(NO_NOTES).alias("notes"), F.expr(NO_BOX).alias("bbox"))


def general_tables(raw: DataFrame) -> DataFrame:
    """Raw tables (page, table_index, rows, bbox if known) in the form of the first normaliser that knows them."""
    raw = raw if "bbox" in raw.columns else raw.withColumn("bbox", F.expr(NO_BOX))
    made = raw.withColumn("table_id", F.concat(F.lit("page_"), F.col("page").cast("string"), F.lit("_table_"), (F.col("table_index") + 1).cast("string")))
    kept = tables.processed(made.select("page", "table_id", "rows"))
    none = F.lit(None)
    return kept.join(made.select("table_id", "table_index", "bbox"), "table_id").select(
        F.col("page").cast("long").alias("page"), F.col("table_index").cast("int").alias("table_index"), "table_id", "type", "title", none.cast("string").alias("year"), none.cast("int").alias("year_credit_hours"), "headers", "rows", "text", F.expr(NO_NOTES).alias("notes"), "bbox")


def page_tables(words: DataFrame, rects: DataFrame, sizes: DataFrame, raw: DataFrame) -> DataFrame:
    """All tables of the pages: words (page, text, x0, x1, top), rects (page, x0, x1, top, height), sizes (page, width,
    height) and raw tables (page, table_index, rows).  A page with curriculum tables has no others."""
    plans = curriculum_tables(words, rects, sizes)
    rest = raw.join(plans.select("page").distinct(), "page", "left_anti")
    return plans.select(*TABLE).unionByName(general_tables(rest).select(*TABLE))

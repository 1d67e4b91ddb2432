"""Records of pages and tables, and the routes from a page's section to its extractors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CALENDAR_PAGES, CALENDAR_TITLE, CALENDAR_WORDS
from ..functions.text import CODE, clean_whitespace, full_cells, lines, paragraphs
from . import entities, tables
from .sections import indexed_pages, section_of

# First cells of a directory's header, one of them torn by the extraction.
HEADER_CELL = r"(?i)^e?partment$|^telephone$|^email$"
RECORD = ["page", "item", "type", "section", "title", "course_code", "text"]


def _records(rows: DataFrame, kind: str, *, section: Column | None = None, title: Column | None = None, code: Column | None = None, text: Column | str = "text") -> DataFrame:
    of = lambda c: (F.lit(None) if c is None else c).cast("string")
    return rows.select(F.col("page").cast("long").alias("page"), F.col("item").cast("int").alias("item"), F.lit(kind).alias("type"), of(section).alias("section"), of(title).alias("title"), of(code).alias("course_code"), (F.col(text) if isinstance(text, str) else text).alias("text"))


def _exploded(pages: DataFrame, parts: Column) -> DataFrame:
    return pages.select("page", F.posexplode(parts).alias("item", "text"))


def calendar_lines(pages: DataFrame) -> DataFrame:
    marked = F.exists(F.array(*[F.lit(w) for w in CALENDAR_WORDS]), lambda w: F.lower("text").contains(w))
    return _records(_exploded(pages, lines(F.col("text"))).where(marked), "calendar_event", title=F.lit(CALENDAR_TITLE))


def curriculum_lines(pages: DataFrame) -> DataFrame:
    rows = _exploded(pages, lines(F.col("text"))).withColumn("code", F.regexp_extract("text", rf"^({CODE})\s+(.+)$", 1)).withColumn("rest", F.trim(F.regexp_extract("text", rf"^({CODE})\s+(.+)$", 2)))
    row = (F.col("code") != "") & (F.length("rest") >= 2) & (F.size(F.split("rest", r"\s+")) <= 20)
    return _records(rows.where(row & (F.col("rest").rlike(r"\b\d+(?:\.\d+)?\b") | F.lower("rest").rlike("elective|required"))), "curriculum_course", code=F.col("code"))


def prose(pages: DataFrame, parts=paragraphs) -> DataFrame:
    rows = _exploded(pages, parts(F.col("text")))
    long = (F.length("text") >= 100) | (F.length("text") >= 40) & F.col("text").rlike(r"[.!?]")
    return _records(rows.where(long), "general_prose", section=section_of(F.col("page")))


def faculty(pages: DataFrame, parts=paragraphs) -> DataFrame:
    return _records(_exploded(pages, parts(F.col("text"))).where(F.length("text") >= 10), "faculty")


def directory_lines(pages: DataFrame) -> DataFrame:
    return _records(_exploded(pages, lines(F.col("text"))).where(F.length("text") >= 3), "directory")


def page_records(pages: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Records of pages (page, text) by their section; excluded pages give none.

    A directory page that has a table (tables: page) is covered by it and gives no lines; on pages of the
    calendar and of programs, lines stay beside the tables.
    """
    kept = indexed_pages(pages).withColumn("section", section_of(F.col("page")))
    if tables is not None:
        covered = tables.where(section_of(F.col("page")) == "directory").select(F.col("page").cast("long").alias("page"), F.lit("directory").alias("section")).distinct()
        kept = kept.join(covered, ["page", "section"], "left_anti")
    at = lambda *names: kept.where(F.col("section").isin(*names))
    calendar = F.col("page").isin(*CALENDAR_PAGES)
    rest = kept.where(~F.col("section").isin("courses", "programs", "faculty", "directory") & ~calendar)
    parts = [calendar_lines(kept.where(calendar)), curriculum_lines(at("programs")), prose(at("programs")), prose(rest), faculty(at("faculty")), directory_lines(at("directory"))]
    return reduce(DataFrame.unionByName, parts)


def page_courses(pages: DataFrame) -> DataFrame:
    kept = indexed_pages(pages).withColumn("section", section_of(F.col("page")))
    listed = kept.where((F.col("section") == "courses") | (F.col("section") == "achievement_courses") & F.col("text").rlike(r"(?i)\bcourse descriptions\b"))
    return entities.courses(listed).unionByName(entities.unnumbered(listed))


def directory_rows(t: DataFrame) -> DataFrame:
    """One record for each table row (page, item, row) of two full cells or more that is no header."""
    cells = full_cells(F.col("row"), clean_whitespace)
    rows = t.withColumn("cells", cells).where((F.size("cells") >= 2) & ~F.col("cells")[0].rlike(HEADER_CELL))
    name = F.col("cells")[0]
    return _records(rows, "directory", section=F.lit("directory"), title=name, text=F.concat(name, F.lit(" — "), F.array_join(F.slice("cells", F.lit(2), F.size("cells")), ", ")))


def calendar_rows(t: DataFrame) -> DataFrame:
    rows = t.withColumn("cells", full_cells(F.col("row"), clean_whitespace)).where(F.size("cells") > 0)
    return _records(rows, "calendar_event", section=F.lit("calendar"), title=F.lit(CALENDAR_TITLE), text=F.array_join("cells", ", "))


def table_records(t: DataFrame) -> DataFrame:
    """Records of tables (page, table_id, title, headers, rows): directory, calendar, curriculum or reference."""
    t = t.withColumn("section", section_of(F.col("page"))).withColumn("item", F.lit(0))
    row = lambda df: df.select("page", F.posexplode("rows").alias("item", "row"))
    is_directory, is_calendar, is_curriculum = F.col("section") == "directory", F.col("page").isin(*CALENDAR_PAGES), F.col("table_id").contains("curriculum")
    md = tables.markdown(F.col("headers"), F.col("rows"))
    named = lambda default: F.coalesce(F.nullif("title", F.lit("")), default)
    whole = t.where(~is_directory & ~is_calendar).withColumn("md", md).where("md <> ''")
    plan, other = whole.where(is_curriculum), whole.where(~is_curriculum)
    title, about = named(F.lit("Proposed Sequence of Study")), named(F.concat(F.lit("Table on page "), F.col("page").cast("string")))
    text = lambda name: F.concat(name, F.lit(" (page "), F.col("page").cast("string"), F.lit("):\n"), F.col("md"))
    return reduce(DataFrame.unionByName, [
        directory_rows(row(t.where(is_directory))), calendar_rows(row(t.where(is_calendar & ~is_directory))),
        _records(plan, "curriculum_course", section=F.lit("programs"), title=title, text=text(title)),
        _records(other, "table", section=F.col("section"), title=about, text=text(about)),
    ])

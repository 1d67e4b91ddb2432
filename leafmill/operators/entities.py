"""Courses out of page text: headers, bodies, titles, prerequisites, and the report on what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DESCRIPTION_CHARS, EXPECTED_CODES, REPORT_ROWS
from ..functions.text import CODE, clean_description, clean_whitespace, one_line

# Patterns of credits, course headers and the one course without a number.
_CREDITS = r"(\d+(?:\.\d+)?-\d+(?:\.\d+)?-\d+(?:\.\d+)?)"
HEADER = rf"({CODE})\s+([A-Z][^\n]{{1,150}}?)\s+\({_CREDITS}\)\."
UNNUMBERED = rf"(BPE)\s+(Bridge\s+Program\s+Elective)\s+\({_CREDITS}\)\."
# Phrases of prose that a title does not have.
PROSE = ["prerequisite:", "prerequisites:", "students are", "students who", "students may", "students must", "students can", "course descriptions", "academic policies", "program requirements", "degree requirements", "the university", "admission to", "achievement academy"]


def valid_title(title: Column, phrases: list[str] = PROSE) -> Column:
    t = clean_whitespace(title)
    prose = F.lit(False)
    for p in phrases:
        prose = prose | F.lower(t).contains(p)
    return F.length(t).between(2, 160) & ~prose & ~t.rlike(rf"\b{CODE}\b") & (F.size(F.split(t, r"\s+")) <= 25) & ~t.endswith(":")


def prerequisites(description: Column) -> Column:
    """Codes after "prerequisite:" up to the next heading word, each once, in order."""
    span = F.regexp_extract(F.coalesce(description, F.lit("")), r"(?i)\bprerequisite[s]?\s*:\s*(.+?)(?=\b(?:corequisite|co-requisite|notes?|course description)\b|$)", 1)
    return F.array_distinct(F.transform(F.regexp_extract_all(span, F.lit(rf"\b{CODE}\b"), F.lit(0)), one_line))


def entries(pages: DataFrame, pattern: str) -> DataFrame:
    """page, item, code, title, credits, body: each match of the pattern with the text up to the next one."""
    marked = F.regexp_replace("text", pattern, "\u0001$1\u0002$2\u0002$3\u0003")
    parts = F.split(marked, "\u0001")
    rows = pages.select("page", F.posexplode(F.slice(parts, F.lit(2), F.size(parts))).alias("item", "part"))
    head, body = F.split(F.substring_index("part", "\u0003", 1), "\u0002"), F.substring_index("part", "\u0003", -1)
    return rows.select("page", "item", one_line(head[0]).alias("course_code"), one_line(head[1]).alias("title"), head[2].alias("format"), body.alias("body"))


def courses(pages: DataFrame, pattern: str = HEADER, checked: bool = True) -> DataFrame:
    """Course rows of pages (page, text).  A match that is no course still ends the one before it."""
    found = entries(pages, pattern)
    found = found.where(valid_title(F.col("title"))) if checked else found
    body = F.substring(one_line(F.regexp_replace(one_line(F.col("body")), r"(?i)\s+Course Descriptions.*$", "")), 1, DESCRIPTION_CHARS)
    return finished(found.select("page", "item", F.lit("course").alias("type"), "course_code", "title", "format", body.alias("description")))


def finished(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("description", clean_description(F.col("description"))).withColumn("prerequisites", prerequisites(F.col("description")))
    text = F.concat("course_code", F.lit(" "), "title", F.lit(" ("), "format", F.lit("). "), "description")
    return rows.withColumn("text", clean_whitespace(text))


def unnumbered(pages: DataFrame) -> DataFrame:
    return courses(pages, UNNUMBERED, checked=False)


def head_and_tail(rows: DataFrame, n: int = REPORT_ROWS) -> DataFrame:
    """part, place, course_code, title: the first and last n courses in corpus order."""
    order = ["page", "item", "course_code"]

    def part(name: str, by: list) -> DataFrame:
        some = rows.orderBy(*by).limit(n)
        return some.select(F.lit(name).alias("part"), F.row_number().over(Window.orderBy(*order)).alias("place"), "course_code", "title")  # n rows

    return part("first", order).unionByName(part("last", [F.desc(c) for c in order]))


def report(rows: DataFrame) -> DataFrame:
    """check, value: how many courses, suspicious titles, and whether the expected codes are there."""
    codes = rows.sparkSession.createDataFrame([(c,) for c in EXPECTED_CODES], "code string")
    counts = rows.agg(F.count(F.lit(1)).alias("courses"), F.count_if(~valid_title(F.col("title"))).alias("suspicious titles"))
    general = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("value")) for c in counts.columns])).alias("x")).select("x.*")
    found = codes.join(rows.groupBy(F.col("course_code").alias("code")).agg(F.count(F.lit(1)).alias("n")), "code", "left")
    return general.unionByName(found.select(F.concat(F.lit("has "), "code").alias("check"), F.coalesce("n", F.lit(0)).alias("value")))

"""Tables: filters, normalisers in their order, text and Markdown.  rows is an array of arrays of strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_whitespace, full_cells, one_line

# Titles that are known, in the order in which they are looked for.
TITLES = ["Required Placement Tests", "Tuition (in AED)", "Compulsory Fees (in AED)"]
# Majors of the placement table, in the order in which they are tried.
MAJORS = ["Architecture/Interior Design", "Biology", "Business Administration (all majors)", "Chemistry and Biochemistry", "Computer Science", "Data Science", "Design Management", "Engineering majors", "English Language and Literature", "Environmental Sciences and Sustainability", "Film and New Media Design/Graphic Design", "International Studies/Psychology", "Media Communication", "Mathematics", "Physics", "Psychology", "Undeclared Major"]
# Headers of the placement table.
PLACEMENT_HEADERS = ["Majors", "Engineering Math", "Business Math", "Architecture Math", "Physics", "English"]
# Grade categories in the order in which they are tried; notation codes; header words.
GRADES = ["excellent", "good", "satisfactory", "poor", "fail", "academic integrity violation fail"]
NOTATIONS = ["AUD", "I", "IP", "N", "P", "NP", "TR", "W", "WV"]
HEADER_WORDS = ["name", "type", "description", "fee", "major", "category", "grade", "class", "credit", "course", "regular semester", "summer term"]
# Rows of the tuition and fees tables that are headers.
TUITION_SKIPPED, FEES_SKIPPED = ["Regular Semester", "Summer Term"], ["Fee Type", "Description", "Regular Semester", "Summer Term"]
RESULT = "struct<title:string,headers:array<string>,rows:array<array<string>>>"


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.expr("cast(array() as array<string>)")


def full_rows(rows: Column) -> Column:
    """Rows of non-empty cells, without empty rows."""
    return F.filter(F.transform(rows, lambda r: full_cells(r)), lambda r: F.size(r) > 0)


def all_text(rows: Column) -> Column:
    return F.array_join(F.flatten(F.transform(rows, lambda r: full_cells(r))), " ")


def has_content(rows: Column) -> Column:
    return F.size(F.flatten(F.transform(rows, lambda r: full_cells(r)))) >= 2


def is_prose(rows: Column) -> Column:
    return F.forall(full_rows(rows), lambda r: F.size(r) == 1)


def title_of(rows: Column) -> Column:
    text, out = all_text(rows), F.lit("")
    for t in reversed(TITLES):
        out = F.when(text.contains(t), F.lit(t)).otherwise(out)
    return out


def _made(title: Column | str, headers: list[str], rows: Column) -> Column:
    return F.struct((F.lit(title) if isinstance(title, str) else title).alias("title"), strings(headers).alias("headers"), rows.alias("rows")).cast(RESULT)


def placement(rows: Column) -> Column:
    def one(row: Column) -> Column:
        text = F.array_join(row, " ")
        major = F.try_element_at(F.filter(strings(MAJORS), lambda m: F.lower(text).contains(F.lower(m))), F.lit(1))
        rest = F.substring(text, F.length(major) + 1, F.length(text))
        strict = F.regexp_extract_all(rest, F.lit(r"(?i)\b(?:Yes|No|\*|\*\*)\b"), F.lit(0))
        values = F.when(F.size(strict) >= 5, strict).otherwise(F.regexp_extract_all(rest, F.lit(r"(?i)Yes|No|\*{1,2}"), F.lit(0)))
        return F.when(major.isNotNull() & (F.size(values) >= 5), F.concat(F.array(major), F.slice(values, 1, 5)))

    found = F.filter(F.transform(full_rows(rows), one), lambda r: r.isNotNull())
    return F.when(all_text(rows).contains(TITLES[0]) & (F.size(found) > 0), _made(TITLES[0], PLACEMENT_HEADERS, found))


def grading(rows: Column) -> Column:
    pattern = r"(?i)\(?([A-F][+-]?)\)?\s*(?:equals|=)?\s*(\d+(?:\.\d+)?)"
    zero = F.expr("named_struct('category', cast(null as string), 'out', cast(array() as array<array<string>>))")

    def step(acc: Column, row: Column) -> Column:
        text = F.array_join(row, " ")
        named = F.try_element_at(F.filter(strings(GRADES), lambda g: F.lower(text).contains(g)), F.lit(1))
        category = F.coalesce(F.initcap(named), acc["category"])
        grade, points = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
        return F.struct(category.alias("category"), F.when(category.isNotNull() & (points != ""), F.concat(acc["out"], F.array(F.array(category, F.upper(grade), points)))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(full_rows(rows), zero, step, lambda acc: acc["out"])
    any_grade = F.exists(strings(GRADES), lambda g: F.lower(all_text(rows)).contains(g))
    return F.when(any_grade & (F.size(found) > 0), _made("", ["Category", "Grade", "Grade Points"], found))


def notation(rows: Column) -> Column:
    found = F.transform(F.filter(full_rows(rows), lambda r: r[0].isin(NOTATIONS) & (F.size(r) >= 2)), lambda r: F.array(r[0], F.array_join(F.slice(r, F.lit(2), F.size(r)), " ")))
    return F.when(F.size(found) > 0, _made("", ["Notation", "Meaning"], found))


def _money(rows: Column, title: str, headers: list[str], skipped: list[str]) -> Column:
    kept = F.filter(full_rows(rows), lambda r: ~(F.array_join(r, " ").contains(title) | F.array_join(r, " ").isin(skipped)))
    return F.when(all_text(rows).contains(title), _made(title, headers, kept))


def generic(rows: Column) -> Column:
    full = full_rows(rows)
    first = F.lower(F.array_join(F.try_element_at(full, F.lit(1)), " "))
    headed = F.exists(strings(HEADER_WORDS), lambda w: first.contains(w))
    made = F.struct(title_of(rows).alias("title"), F.when(headed, F.try_element_at(full, F.lit(1))).otherwise(strings([])).alias("headers"), F.when(headed, F.slice(full, F.lit(2), F.greatest(F.size(full) - 1, F.lit(0)))).otherwise(full).alias("rows"))
    return F.when(F.size(full) > 0, made.cast(RESULT))


def normalised(rows: Column) -> Column:
    """title, headers, rows by the first normaliser that knows the table; null for prose and near-empty tables."""
    tuition = _money(rows, TITLES[1], ["Item", "Regular Semester", "Summer Term"], TUITION_SKIPPED)
    fees = _money(rows, TITLES[2], FEES_SKIPPED, FEES_SKIPPED)
    return F.when(has_content(rows) & ~is_prose(rows), F.coalesce(placement(rows), grading(rows), notation(rows), tuition, fees, generic(rows)))


def table_text(page: Column, title: Column, headers: Column, rows: Column) -> Column:
    parts = F.concat(F.array(F.concat(F.lit("Page: "), page.cast("string"))), F.when(title != "", F.array(title)).otherwise(strings([])),
                     F.when(F.size(headers) > 0, F.array(F.array_join(headers, " | "))).otherwise(strings([])), F.transform(rows, lambda r: F.array_join(full_cells(r), " | ")))
    return F.array_join(parts, "\n")


def curriculum_text(page: Column, year: Column, rows: Column) -> Column:
    full = F.filter(F.transform(rows, lambda r: F.array_join(F.filter(r, lambda x: x != ""), " | ")), lambda x: x != "")
    return F.array_join(F.concat(F.array(F.concat(F.lit("Page: "), page.cast("string")), F.lit("Proposed Sequence of Study"), year), full), "\n")


def markdown(headers: Column, rows: Column) -> Column:
    """A pipe table; without headers the first row is one; rows are padded to the widest; empty for no rows."""
    rows = F.filter(F.transform(rows, lambda r: F.transform(r, clean_whitespace)), lambda r: F.exists(r, lambda x: x != ""))
    headed = F.size(headers) > 0
    every = F.when(headed, F.concat(F.array(headers), rows)).otherwise(rows)
    width = F.array_max(F.transform(every, lambda r: F.size(r)))
    pad = lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(pad(r), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    made = F.transform(every, line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(made, 1, 1), F.array(rule), F.slice(made, F.lit(2), F.size(made))), "\n")).otherwise("")


def processed(tables: DataFrame) -> DataFrame:
    """tables (page, table_id, rows) as title, headers, rows, text; others fall out."""
    made = tables.withColumn("t", normalised(F.col("rows"))).where("t is not null")
    return made.select("page", "table_id", F.lit("table").alias("type"), "t.title", "t.headers", "t.rows", table_text(F.col("page"), F.col("t.title"), F.col("t.headers"), F.col("t.rows")).alias("text"))


def cells_cleaned(row: Column) -> Column:
    return F.transform(row, one_line)

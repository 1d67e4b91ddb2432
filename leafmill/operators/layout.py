"""Page layout: reading order, lines of words, rules, bands and curriculum tables.

Positions are those of a PDF page, y downwards.  Words are rows (page, text, x0, x1, top); ruled lines are rows
(page, x0, x1, top, height); lines are told apart in one array of a page's places, by jumps from line to line.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..functions.text import clean_whitespace, one_line, repaired_code

# The heading of a year's table, and cells that hold a course code.
YEAR = r"(?i)(FIRST|SECOND|THIRD|FOURTH|FIFTH)\s+YEAR\s*\(\s*(\d+)\s+credit\s+hours\s*\)"
CODE_CELL = (
    r"(?i)^(?:[A-Z]{2,5}\s+\d{3}[A-Z]?(?:\s+or\s+(?:[A-Z]{2,5}\s+\d{3}[A-Z]?|FRE|MJE|MCE))?"
    r"|FRE|MJE|MCE|[A-Z]{2,5}-[A-Za-z]+)$"
)

#: Words of a panel that one sweep over its bands takes, about.
SWEPT = 100_000


def without_bands(blocks: DataFrame, band: float = 50.0) -> DataFrame:
    """Blocks (page, height, x0, y0, x1, y1, text) that do not lie in the header or footer band and have text."""
    return blocks.where((F.col("y1") > band) & (F.col("y0") < F.col("height") - band) & (clean_whitespace(F.col("text")) != ""))


def page_texts(blocks: DataFrame) -> DataFrame:
    """page, text: blocks from top to bottom, then left to right, one a line."""
    item = F.struct("y0", "x0", "text")
    return blocks.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda b: b["text"]), "\n").alias("text"))


def column_number(x0: Column, x1: Column, width: Column) -> Column:
    share = (x0 + x1) / 2 / width
    return F.when(share < 0.34, 0).when(share < 0.67, 1).otherwise(2)


def reading_order(blocks: DataFrame) -> DataFrame:
    """Blocks (page, ord, x0, y0, x1, text) with their column and position: down each of three columns."""
    width = F.max("x1").over(Window.partitionBy("page"))
    placed = blocks.where(clean_whitespace(F.col("text")) != "").withColumn("column", column_number(F.col("x0"), F.col("x1"), width))
    order = Window.partitionBy("page").orderBy("column", F.bround("y0", 1), F.bround("x0", 1), "ord")
    return placed.withColumn("position", F.row_number().over(order))


def _anchors(v: np.ndarray, reach: float) -> np.ndarray:
    """Places in sorted numbers where a group begins: it takes all that lies within reach of its first number."""
    after, out, i, n = np.searchsorted(v, v + reach, "right"), [], 0, len(v)
    while i < n:
        out.append(i)
        j = max(int(after[i]), i + 1)
        # the sum above may be rounded otherwise than the difference; a missing number is in the last group
        while j - 1 > i and v[j - 1] - v[i] > reach:
            j -= 1
        while j < n and not v[j] - v[i] > reach:
            j += 1
        i = j
    return np.array(out, np.int64)


def _of_numbers(kernel: Callable[[np.ndarray], np.ndarray], kind: str) -> Callable[[Column], Column]:
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else kernel(np.asarray(v, np.float64)).tolist())

    return F.pandas_udf(run, kind)


def anchored_lines(values: Column, tolerance: float = 3.0) -> Column:
    """For sorted numbers, the line of each: a line reaches as far as the tolerance from its first number."""

    def lines(v: np.ndarray) -> np.ndarray:
        first = np.zeros(len(v), np.int32)
        first[_anchors(v, tolerance)] = 1
        return np.cumsum(first) - 1

    return _of_numbers(lines, "array<int>")(values)


def thinned(values: Column, gap: float = 1.0) -> Column:
    """Sorted numbers without those that lie within the gap of the last one kept."""
    return _of_numbers(lambda v: v[_anchors(v, gap)], "array<double>")(values)


def words_in_lines(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """words with their line number on the page."""
    item = F.struct("top", "x0", "x1", "text")
    pages = words.groupBy("page").agg(F.array_sort(F.collect_list(item)).alias("w"))
    lined = pages.select("page", "w", anchored_lines(F.transform("w", lambda x: x["top"]), tolerance).alias("l"))
    return lined.select("page", F.explode(F.arrays_zip("l", "w")).alias("z")).select("page", F.col("z.l").alias("line"), "z.w.text", "z.w.x0", "z.w.x1", "z.w.top")


def line_texts(lined: DataFrame) -> DataFrame:
    """page, line, top, text."""
    item = F.struct("x0", "text")
    return lined.groupBy("page", "line").agg(F.min("top").alias("top"), one_line(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda w: w["text"]), " ")).alias("text"))


def is_curriculum_page(text: Column) -> Column:
    return text.rlike(YEAR) & text.contains("Course #")


def year_heading(text: Column) -> Column:
    """year and credit_hours, or null."""
    found = F.regexp_extract(text, YEAR, 1)
    return F.when(found != "", F.struct(F.concat(F.initcap(found), F.lit(" Year")).alias("year"), F.regexp_extract(text, YEAR, 2).cast("int").alias("credit_hours")))


def is_code_cell(text: Column) -> Column:
    return one_line(text).rlike(CODE_CELL)


def starts_with_code(words: Column) -> Column:
    return F.array_join(F.slice(words, 1, 6), " ").rlike(r"\b[A-Z]{2,5}\s+\d{3}[A-Z]?\b|\bGER-[A-Za-z]+\b|\b(?:FRE|MJE|MCE)\b")


def is_column_header(text: Column) -> Column:
    low = F.lower(text)
    return low.contains("term") & low.contains("course") & low.contains("title") & low.contains("hours")


def panel_rules(rects: DataFrame, panels: DataFrame, width: float = 100.0, overlap: float = 80.0) -> DataFrame:
    """page, panel, ys: thin rules that reach far enough into a panel (page, panel, left, right)."""
    joined = rects.join(panels, "page").where((F.col("height") <= 1) & (F.col("x1") - F.col("x0") >= width) & (F.least("x1", "right") - F.greatest("x0", "left") >= overlap))
    return joined.groupBy("page", "panel").agg(thinned(F.array_sort(F.collect_list("top"))).alias("ys"))


def bands(rules: DataFrame) -> DataFrame:
    """page, panel, band, upper, lower from rules (page, panel, ys)."""
    return rules.where(F.size("ys") > 1).select("page", "panel", "ys", F.posexplode(F.slice("ys", F.lit(1), F.size("ys") - 1)).alias("band", "upper")).select(
        "page", "panel", "band", "upper", F.element_at("ys", F.col("band") + 2).alias("lower"))


def words_in_bands(words: DataFrame, banded: DataFrame, panels: DataFrame, most: int = SWEPT) -> DataFrame:
    """Words strictly inside a band of their panel; bands of one panel do not overlap.

    Words and bands are swept together down each panel: a word can only lie in the last band that begins above it, so a
    word is one row, whatever the number of bands.  The words of a panel with more than ``most`` of them are dealt to several
    sweeps, each of which has all its bands.
    """
    inside = words.join(panels, "page").where((F.col("x0") >= F.col("left")) & (F.col("x0") < F.col("right")))
    many = inside.groupBy("page", "panel").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    many = many.select("page", "panel", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    names = inside.columns
    band = F.struct(*[c for c in banded.columns if c not in ("page", "panel")])
    down = inside.join(many, ["page", "panel"], "left").select("page", "panel", F.pmod(F.xxhash64("top", "x0", "text"), parts).cast("int").alias("part"), F.col("top").alias("at"), F.lit(None).cast(_kind(banded, band)).alias("band"), F.struct(*names).alias("word"))
    starts = banded.join(many, ["page", "panel"], "left").select("page", "panel", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("upper").alias("at"), band.alias("band"), F.lit(None).cast(_kind(inside, F.struct(*names))).alias("word"))
    sweep = Window.partitionBy("page", "panel", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = down.unionByName(starts).withColumn("band", F.last("band", ignorenulls=True).over(sweep))
    found = met.where("word is not null and at > band.upper + 0.5 and at < band.lower - 0.5")
    return found.select("page", "panel", *(F.col(f"word.{c}") for c in names if c not in ("page", "panel")), *(F.col(f"band.{c}") for c in banded.columns if c not in ("page", "panel")))


def _kind(df: DataFrame, c: Column) -> DataType:
    return df.select(c.alias("c")).schema["c"].dataType


def cell_column(x0: Column, course: Column, title: Column, credit: Column) -> Column:
    return F.when(x0 < course, "term").when(x0 < title, "course").when(x0 < credit, "title").otherwise("credit")


def inferred_columns(header_words: DataFrame) -> DataFrame:
    """page, panel and where the columns begin, from header words (page, panel, left, right, text, x0)."""
    low = F.lower("text")
    of = lambda word: F.min(F.when(low.contains(word), F.col("x0")))
    courses = F.array_sort(F.collect_set(F.when(low.contains("course"), F.col("x0"))))
    return header_words.groupBy("page", "panel", "left", "right").agg(of("term").alias("t"), courses.alias("c"), of("credit").alias("k")).select(
        "page", "panel",
        F.coalesce("t", F.col("left") + 4).alias("term"),
        F.coalesce(F.try_element_at("c", F.lit(1)), F.col("left") + 35).alias("course"),
        F.coalesce(F.try_element_at("c", F.lit(2)), F.col("left") + 75).alias("title"),
        F.coalesce(F.col("k") - 5, F.col("right") - 25).alias("credit"),
    )


def curriculum_rows(words: DataFrame, rects: DataFrame, panels: DataFrame, header_words: DataFrame) -> DataFrame:
    """page, panel, band and the four cells of each row between rules, cleaned and filled.

    panels: page, panel, left, right, from_top, to_top (a block of the panel); rows without a course code go
    unless they are totals; an empty term takes the last one above it.
    """
    frame = panels.select("page", "panel", "left", "right")
    banded = bands(panel_rules(rects, frame))
    inside = words_in_bands(words.join(panels.select("page", "from_top", "to_top").distinct(), "page").where("top >= from_top and top < to_top").drop("from_top", "to_top"), banded, frame)
    placed = inside.join(inferred_columns(header_words), ["page", "panel"])
    named = placed.withColumn("cell", cell_column(F.col("x0"), F.col("course"), F.col("title"), F.col("credit")))
    part = lambda name: one_line(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("cell") == name, F.struct("top", "x0", "text")))), lambda w: w["text"]), " "))
    rows = named.groupBy("page", "panel", "band").agg(*[part(n).alias(f"c_{n}") for n in ("term", "course", "title", "credit")])
    return filled_rows(rows)


def filled_rows(rows: DataFrame) -> DataFrame:
    """Cleaned curriculum rows of page, panel, band, c_term, c_course, c_title, c_credit."""
    code = F.regexp_replace(F.regexp_replace(repaired_code(F.col("c_course")), r"(?i)\bGER-Cor\s+e\b", "GER-Core"), r"(?i)\bGER-CO\s+M\b", "GER-COM")
    moved = (F.col("c_term") == "") & F.col("code").isin("Fall", "Spring", "Summer")
    rows = rows.withColumn("code", code).withColumn("term", F.when(moved, F.col("code")).otherwise(one_line(F.col("c_term")))).withColumn("code", F.when(moved, "").otherwise(F.col("code")))
    every = F.concat_ws(" ", "term", "code", "c_title", "c_credit")
    total = every.rlike(r"(?i)total") & ~every.rlike(r"(?i)\b[A-Z]{2,5}\s+\d{3}\b")
    number = F.regexp_extract(every, r"\b(\d+(?:\.\d+)?)\b", 1)
    rows = rows.select("page", "panel", "band", total.alias("total"), "term", "code", one_line(F.col("c_title")).alias("title"), one_line(F.col("c_credit")).alias("credit"), number.alias("number"))
    rows = rows.where(F.col("total") | is_code_cell(F.col("code")))
    rows = rows.select("page", "panel", "band", F.when(F.col("total"), "").otherwise(F.col("term")).alias("term"), F.when(F.col("total"), "").otherwise(F.col("code")).alias("code"),
                       F.when(F.col("total"), "Total").otherwise(F.col("title")).alias("title"), F.when(F.col("total") & (F.col("number") != ""), F.col("number")).otherwise(F.col("credit")).alias("credit"))
    above = Window.partitionBy("page", "panel").orderBy("band").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("term", F.coalesce(F.last(F.nullif("term", F.lit("")), ignorenulls=True).over(above), F.lit("")))


def curriculum_blocks(words: DataFrame, rects: DataFrame, page_size: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """page, panel, heading_top, year, credit_hours and rows: every year's table on two-panel pages.

    page_size: page, width, height.  A heading is five words in a row; it belongs to the half of the page it
    begins in and its block ends at the next heading of that half.
    """
    lined = words_in_lines(words, tolerance)
    five = Window.partitionBy("page", "line").orderBy("x0")
    run = F.concat_ws(" ", "text", *[F.lead("text", i).over(five) for i in range(1, 5)])
    heads = lined.withColumn("run", run).where(F.col("run").rlike("^" + YEAR + "$")).join(page_size, "page")
    heads = heads.withColumn("panel", F.when(F.col("x0") < F.col("width") / 2, 0).otherwise(1))
    following = F.lead("top").over(Window.partitionBy("page", "panel").orderBy("top"))
    heads = heads.select("page", "panel", F.when(F.col("panel") == 0, 0.0).otherwise(F.col("width") / 2).alias("left"), F.when(F.col("panel") == 0, F.col("width") / 2).otherwise(F.col("width")).alias("right"),
                         F.col("top").alias("from_top"), F.coalesce(following, F.col("height")).alias("to_top"), year_heading(F.col("run")).alias("y"))
    # every block is a panel of its own from here on
    blocks = heads.withColumn("block", F.concat_ws("/", "panel", "from_top")).withColumnRenamed("panel", "side").withColumnRenamed("block", "panel")
    near = lined.join(blocks, "page").where((F.col("x0") >= F.col("left")) & (F.col("x0") < F.col("right")) & (F.col("top") > F.col("from_top")) & (F.col("top") < F.col("to_top")))
    has = near.groupBy("page", "panel", "line").agg((F.max(F.lower("text").contains("term").cast("int")) + F.max(F.lower("text").contains("course").cast("int"))).alias("n"))
    first = has.where("n = 2").groupBy("page", "panel").agg(F.min("line").alias("first"))
    ends = near.where(F.lower("text").contains("hours")).join(first, ["page", "panel"]).where("line >= first and line <= first + 3").groupBy("page", "panel").agg(F.min("line").alias("end"))
    header = near.join(first, ["page", "panel"]).join(ends, ["page", "panel"], "left").where(F.col("line").between(F.col("first"), F.coalesce("end", F.col("first") + 3)))
    banded = bands(panel_rules(rects.join(blocks.select("page", "from_top", "to_top").distinct(), "page").where("top > from_top and top <= to_top").drop("from_top", "to_top").distinct(), blocks.select("page", "panel", "left", "right")))
    spans = blocks.select("page", "panel", "from_top", "to_top")
    banded = banded.join(spans, ["page", "panel"]).where("upper > from_top and lower <= to_top").drop("from_top", "to_top")
    inside = words_in_bands(words, banded, blocks.select("page", "panel", "left", "right")).join(inferred_columns(header), ["page", "panel"])
    named = inside.withColumn("cell", cell_column(F.col("x0"), F.col("course"), F.col("title"), F.col("credit")))
    part = lambda name: one_line(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("cell") == name, F.struct("top", "x0", "text")))), lambda w: w["text"]), " "))
    rows = filled_rows(named.groupBy("page", "panel", "band").agg(*[part(n).alias(f"c_{n}") for n in ("term", "course", "title", "credit")]))
    listed = rows.groupBy("page", "panel").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "term", "code", "title", "credit"))), lambda r: F.array(r["term"], r["code"], r["title"], r["credit"])).alias("rows"))
    return blocks.join(listed, ["page", "panel"]).select("page", F.col("side").alias("panel"), F.col("from_top").alias("heading_top"), "y.year", "y.credit_hours", "rows")

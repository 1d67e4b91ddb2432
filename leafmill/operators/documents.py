"""First-wins dedup, positional ids, the unified documents and flat metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..plans.stages import materialised


def first_wins(rows: DataFrame, keys: list[Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key in the given order.

    The row's place is a minimum that is aggregated before it is shuffled, so a hot key is one row a task.
    """
    named = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    place = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)])
    keyed = rows.select("*", *named, place.alias("__place"))
    first = keyed.groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(F.min("__place").alias("__place")).select("__place")
    # rows that share a place are repeats of one another: one of them stays
    return keyed.join(first, "__place", "left_semi").dropDuplicates([f"__k{i}" for i in range(len(keys))]).select(*rows.columns)


def dedup_courses(rows: DataFrame) -> DataFrame:
    return first_wins(rows, [strip(F.col("course_code")), F.lower(strip(F.col("title"))), F.col("page")], ["page", "item"])


def dedup_records(rows: DataFrame) -> DataFrame:
    return first_wins(rows, [F.col("type"), F.col("page"), F.lower(strip(F.col("text")))], ["page", "item", "type", F.xxhash64("text")])


def numbered(rows: DataFrame, order: str, ties: list[str], name: str = "position", block: int | None = None) -> DataFrame:
    """rows with their 0-based position by a column and ties.

    Rows are dealt by ranges of their order, sorted within them and numbered there; a range starts where the
    counts of those before it end.  So no task sees all rows, whatever the values are.  The ranges are written, as
    their bounds come from a sample.  block: rows that a range aims at, if not Spark's own number of partitions.
    """
    by = [order, *ties]
    ranged = rows.repartitionByRange(max(1, min(1024, -(-rows.count() // block))), *by) if block else rows.repartitionByRange(*by)
    ranged = materialised(ranged.sortWithinPartitions(*by).withColumn("__m", F.monotonically_increasing_id()))
    part, at = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ranged.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = counts.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    placed = ranged.withColumn("__p", part).join(F.broadcast(starts), "__p")
    return placed.withColumn(name, (at + F.col("__s")).cast("long")).drop("__p", "__s", "__m")


def unified(courses: DataFrame, records: DataFrame) -> DataFrame:
    """id, type, section, page, course_code, title, metadata, text; records keep code and title in metadata only."""
    null = F.lit(None).cast("string")

    def meta(kind: Column, section: Column, code: Column, title: Column, fmt: Column, pre: Column) -> Column:
        parts = {"type": kind, "section": section, "page": F.col("page").cast("long"), "course_code": code, "title": title, "format": fmt, "prerequisites": pre}
        return F.struct(*[c.alias(n) for n, c in parts.items()]).alias("metadata")

    c = numbered(courses, "page", ["item", "course_code"]).select(
        F.format_string("course_%05d", "position").alias("id"), "type", F.lit("course_descriptions").alias("section"), F.col("page").cast("long").alias("page"), "course_code", "title",
        meta(null, null, F.col("course_code"), F.col("title"), F.col("format"), F.col("prerequisites")), "text")
    r = numbered(records, "page", ["item", "type", "text"]).select(
        F.format_string("record_%05d", "position").alias("id"), "type", F.coalesce("section", F.lit("unknown")).alias("section"), F.col("page").cast("long").alias("page"), null.alias("course_code"), null.alias("title"),
        meta(F.col("type"), F.col("section"), F.col("course_code"), F.col("title"), null, F.expr("cast(null as array<string>)")), "text")
    return c.unionByName(r)


def flat_metadata(chunks: DataFrame) -> DataFrame:
    """Scalars only and no nulls, for a vector store."""
    text = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c], F.lit(""))
    return chunks.select(
        "id", text("document_id").alias("document_id"), text("type").alias("type"), text("section").alias("section"), F.coalesce("page", F.lit(0)).cast("long").alias("page"),
        text("course_code", "metadata.course_code").alias("course_code"), text("title", "metadata.title").alias("title"), text("metadata.format").alias("format"),
        F.coalesce(F.array_join("metadata.prerequisites", ", "), F.lit("")).alias("prerequisites"))

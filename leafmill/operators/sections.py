"""Sections of pages, excluded pages, and the histogram of sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EXCLUDED_RANGES, SECTION_RANGES


def section_of(page: Column) -> Column:
    """The first section by precedence whose pages include this one."""
    out = F.lit("unknown")
    for name, a, b in reversed(SECTION_RANGES):
        out = F.when(page.between(a, b), F.lit(name)).otherwise(out)
    return out


def is_excluded(page: Column) -> Column:
    out = F.lit(False)
    for a, b in EXCLUDED_RANGES:
        out = out | page.between(a, b)
    return F.coalesce(out, F.lit(False))


def with_section(pages: DataFrame) -> DataFrame:
    return pages.withColumn("section", section_of(F.col("page")))


def indexed_pages(pages: DataFrame) -> DataFrame:
    return pages.where(~is_excluded(F.col("page")))


def histogram(pages: DataFrame) -> DataFrame:
    named = F.when(is_excluded(F.col("page")), F.lit("exclude")).otherwise(section_of(F.col("page")))
    return pages.groupBy(named.alias("section")).agg(F.count(F.lit(1)).alias("n_pages")).orderBy("section")

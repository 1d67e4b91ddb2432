"""From pages and tables to chunks in one call, every stage written, with a histogram of sections and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunking, documents, entities, records, sections

#: What is written under the path, in order.
STAGES = ("courses", "records", "documents", "chunks", "histogram", "diagnostics")


def preprocess(pages: DataFrame, path: str, tables: DataFrame | None = None) -> dict[str, DataFrame]:
    """Write the stages of pages (page, text) and tables as Parquet under path; the stages as they were written.

    courses and records are without repeats, which the diagnostics count; histogram has the pages of each section.
    diagnostics (check, value): rows of every stage, repeats dropped, records of each type, texts of no length, the longest
    chunk, suspicious course titles and whether the expected codes are there.
    """
    spark, out = pages.sparkSession, {}

    def stage(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        out[name] = spark.read.schema(df.schema).parquet(f"{path}/{name}")
        return out[name]

    courses = records.page_courses(pages)
    found = records.page_records(pages, tables)
    if tables is not None:
        found = found.unionByName(records.table_records(tables))
    every = {"courses": stage("all_courses", courses), "records": stage("all_records", found)}
    stage("courses", documents.dedup_courses(every["courses"]))
    stage("records", documents.dedup_records(every["records"]))
    stage("documents", documents.unified(out["courses"], out["records"]))
    stage("chunks", chunking.chunks(out["documents"]))
    stage("histogram", sections.histogram(pages))

    count = lambda name, c: F.struct(F.lit(name).alias("check"), c.cast("long").alias("value"))
    row = lambda df, *checks: df.agg(F.array(*checks).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    n = F.count(F.lit(1))
    parts = [row(pages, count("pages", n))]
    parts += [row(out[s], count(s, n), count(f"{s} without text", F.count_if(F.coalesce(F.length("text"), F.lit(0)) == 0))) for s in STAGES[:4]]
    for s, rows in every.items():
        parts.append(row(rows.select(F.lit(1).alias("n")).unionByName(out[s].select(F.lit(-1).alias("n"))), count(f"{s} dropped as repeats", F.coalesce(F.sum("n"), F.lit(0)))))
    parts.append(out["records"].groupBy(F.concat(F.lit("records of type "), F.coalesce("type", F.lit("?"))).alias("check")).agg(n.alias("value")))
    parts.append(row(out["chunks"], count("longest chunk", F.coalesce(F.max(F.length("text")), F.lit(0)))))
    parts.append(entities.report(out["courses"]).select("check", F.col("value").cast("long").alias("value")).where("check <> 'courses'"))
    checks = parts[0]
    for p in parts[1:]:
        checks = checks.unionByName(p)
    stage("diagnostics", checks)
    return {s: out[s] for s in STAGES}

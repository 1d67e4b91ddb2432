"""Pages, tables and their JSON or Parquet files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.stages import materialised

BLOCKS = "array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>"
PAGES = f"page string, page_number string, page_num string, number string, text string, content string, page_text string, full_text string, blocks {BLOCKS}"
TABLES = "table_id string, table_index int, page int, title string, type string, headers array<string>, rows array<array<string>>, year string, year_credit_hours int, text string"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page, text, blocks of a pages file: number and text under any of their names, else from position and blocks."""
    raw = spark.read.schema(PAGES).option("multiLine", True).json(path)
    # the place in its file; a multi-line file is read by one task in any case
    raw = raw.withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id())
    raw = raw.withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy("at")))
    number = F.coalesce(*[F.expr(f"try_cast({c} as int)") for c in ("page", "page_number", "page_num", "number")], F.col("place"))
    text = F.coalesce(*[F.when(F.trim(c) != "", F.col(c)) for c in ("text", "content", "page_text", "full_text")], F.array_join(F.transform("blocks", lambda b: b["text"]), "\n"), F.lit(""))
    return raw.select(number.alias("page"), text.alias("text"), "blocks")


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """The tables file, or no rows where there is none."""
    if not exists(spark, path):
        return spark.createDataFrame([], TABLES)
    return spark.read.schema(TABLES).option("multiLine", True).json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(f"no chunks at {path}")
    df = spark.read.parquet(path)
    if missing := {"id", "text"} - set(df.columns):
        raise ValueError(f"chunks lack {sorted(missing)}")
    return df


def read_pdf_layout(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """files, and words, rects, sizes and raw tables of PDF files, as ``extraction.page_tables`` takes them.

    Each file is parsed once and what it has is written.  Pages of several files are numbered on: files (file,
    first_page, pages) says where each begins.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    row = "kind string, file string, page int, text string, x0 double, x1 double, top double, height double, table_index int, cells array<array<string>>, bbox array<double>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import pymupdf
        except ImportError as e:
            raise ImportError("reading PDF files needs pymupdf") from e
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with pymupdf.open(stream=bytes(content), filetype="pdf") as pdf:
                    for n, page in enumerate(pdf, 1):
                        rows = [("word", name, n, w[4], w[0], w[2], w[1], None, None, None, None) for w in page.get_text("words")]
                        rows += [("rect", name, n, None, d["rect"].x0, d["rect"].x1, d["rect"].y0, d["rect"].height, None, None, None) for d in page.get_drawings()]
                        rows.append(("size", name, n, None, 0.0, page.rect.width, 0.0, page.rect.height, None, None, None))
                        found = page.find_tables(vertical_strategy="lines", horizontal_strategy="lines", intersection_tolerance=5).tables
                        rows += [("table", name, n, None, None, None, None, None, i, t.extract(), [float(x) for x in t.bbox]) for i, t in enumerate(found)]
                        yield pd.DataFrame(rows, columns=[c.split()[0] for c in row.split(", ")])

    every = materialised(files.mapInPandas(run, row))
    # a row a file
    pages = every.where("kind = 'size'").groupBy("file").agg(F.max("page").alias("pages"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    placed = pages.select("file", (F.coalesce(F.sum("pages").over(before), F.lit(0)) + 1).cast("int").alias("first_page"), F.col("pages").cast("int").alias("pages"))
    numbered = every.join(F.broadcast(placed), "file").withColumn("page", F.col("page") + F.col("first_page") - 1)
    of = lambda kind, *columns: numbered.where(F.col("kind") == kind).select("page", *columns)
    return {
        "files": placed, "words": of("word", "text", "x0", "x1", "top"), "rects": of("rect", "x0", "x1", "top", "height"),
        "sizes": of("size", F.col("x1").alias("width"), "height"), "raw": of("table", "table_index", F.col("cells").alias("rows"), "bbox"),
    }


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """page, height, x0, y0, x1, y1, text: text blocks of PDF files, where a PDF library is installed."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import pymupdf
        except ImportError as e:
            raise ImportError("reading PDF files needs pymupdf") from e
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with pymupdf.open(stream=bytes(content), filetype="pdf") as pdf:
                    for i, page in enumerate(pdf):
                        rows = [(name, i + 1, page.rect.height, *b[:5]) for b in page.get_text("blocks") if len(b) > 4]
                        yield pd.DataFrame(rows, columns=["path", "page", "height", "x0", "y0", "x1", "y1", "text"])

    return files.mapInPandas(run, "path string, page int, height double, x0 double, y0 double, x1 double, y1 double, text string")

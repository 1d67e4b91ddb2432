"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches handed to Python tasks: rows and bytes, so that a run of very long texts stays small.
BATCH_ROWS, BATCH_BYTES = 4096, 32 << 20

#: Lower-cases A-Z and turns every byte outside 0-9, a-z and UTF-8 multi-byte sequences into a space.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names; one of this machine only where Spark runs on it alone."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete what ``written`` made, once all that reads it has been written itself."""
    for df in frames:
        if path := getattr(df, "_written_to", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Keys that are broadcast at most (some 30 bytes each), and rows of one key that may meet in one task in any case.
BROADCAST_KEYS, SPLIT = 1 << 19, 256


def looked_up(rows: DataFrame, by: DataFrame, key: str, value: str, spread: str, total: int) -> DataFrame:
    """rows with the value of their key from ``by`` (key, value, n rows of that key of total), null where it has none.

    Keys with more than SPLIT rows and than a BROADCAST_KEYS-th of all are fewer than BROADCAST_KEYS: they are
    broadcast, and their rows are spread by another column, so that no task gets all rows of a frequent key.
    """
    often = F.col("n") > max(SPLIT, total // BROADCAST_KEYS)
    first = F.broadcast(by.where(often).select(key, F.col(value).alias("__often")))
    # no plain literal, which would leave the join with the one key
    rest = by.where(~often).select(key, F.col(value).alias("__rest"), F.when(F.col("n") > 0, F.lit(-1)).alias("__part"))
    part = F.when(F.col("__often").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(spread), F.lit(1 << 16)).cast("int"))
    met = rows.join(first, key, "left").withColumn("__part", part).join(rest, [key, "__part"], "left")
    return met.withColumn(value, F.coalesce("__often", "__rest")).drop("__part", "__often", "__rest")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and bytes; stricter settings of the session stay."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        have = spark.conf.get(name).rstrip("bB")
        if not have.isdigit() or not 0 < int(have) <= most:
            spark.conf.set(name, most)


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (a null id counts as empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128 bits of a row's id and text; repeated rows share it, and a null is no empty string."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(part(doc_id), F.lit("\x00"), part(text)).cast("binary")))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """mapInArrow with a function from one batch to a dict of columns, by the names in the schema."""
    bounded_batches(df.sparkSession)
    target = DataFrameSchema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield target.batch(fn(batch))

    return df.mapInArrow(run, schema)


class DataFrameSchema:
    """Arrow columns for a DDL string of simple types and arrays of them."""

    KINDS = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(),
        "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
        "array<string>": pa.list_(pa.string()), "array<float>": pa.list_(pa.float32()),
    }

    def __init__(self, ddl: str) -> None:
        self.fields = [tuple(x.split()) for x in ddl.split(",")]

    def batch(self, columns: dict) -> pa.RecordBatch:
        arrays = []
        for name, kind in self.fields:
            v = columns[name]
            arrays.append(v if isinstance(v, pa.Array) and v.type == self.KINDS[kind] else pa.array(v, self.KINDS[kind]) if not isinstance(v, pa.Array) else v.cast(self.KINDS[kind]))
        return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in self.fields])

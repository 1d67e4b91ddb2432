"""Incremental indexing of arriving chunk files, resumable by its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import vectors
from ..plans.segments import Segments


def ingest(spark: SparkSession, source: str, schema: str, store: str, checkpoint: str) -> StreamingQuery:
    """Embed chunks (id, text) that arrive as Parquet files under source and are new to the store.

    A batch that runs again after a failure finds its ids in the store and adds nothing.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        from ..sources.pages import exists

        rows = df.dropDuplicates(["id"])
        if exists(spark, store):
            rows = vectors.missing(rows, spark.read.parquet(store))
        vectors.embed(rows).withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(store)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_changes(spark: SparkSession, source: str, schema: str, index: Segments, checkpoint: str, merge: bool = True) -> StreamingQuery:
    """Apply files of changes (see ``Segments``) as they arrive, a segment a batch; small segments are merged in between.

    A batch that runs again after a failure finds its epoch in the manifest and changes nothing.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        index.apply(df, epoch)
        if merge:
            index.merge()

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_each(events: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """A stream without repeats of a key that arrive within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])

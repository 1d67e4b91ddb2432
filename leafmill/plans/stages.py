"""Where a plan is cut: results that several later steps read are written to the cluster's checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of this machine only where Spark runs on it alone."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def materialised(df: DataFrame) -> DataFrame:
    """df as a checkpoint."""
    _root(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as compressed files beside the checkpoints: for what is large and has plain columns, a fraction of a checkpoint."""
    at = folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: Bytes of input for each core, by a plan's estimate, from which on it fills the cores by itself.
SMALL = 64 << 20


def dealt(df: DataFrame, small: int = SMALL) -> DataFrame:
    """df, its rows dealt to all cores where it is small: a file of one row group is one task, however long its work.

    Inputs of more than ``small`` bytes a core are not moved, nor those of unknown size.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if size <= small * cores else df


def folder(spark: SparkSession, name: str) -> str:
    """A new path beside the checkpoints."""
    return f"{_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

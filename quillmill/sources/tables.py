"""Parquet tables: reading them evenly, and keeping intermediate ones where all executors see them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """The rows over as many partitions as there are cores, where the files give fewer; a large table stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see, as the session names it; on one machine, where none is named, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="spark-checkpoint-")


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows, written as a table (in the shared folder unless `path` says where) and read again.

    Cuts the lineage; unlike a checkpoint's, the size estimates of the result are those of the table.
    """
    at = path or f"{shared_folder(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)

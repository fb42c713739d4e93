"""Capture streams: privacy state carried from batch to batch, and receipts that are written once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as X
from ..sources.tables import shared_folder

def privacy_toggle(text: Column) -> Column:
    """True where a text pauses the capture, false where it lifts the pause, null elsewhere."""
    return F.when(text.rlike(X.PRIVACY_OFF), True).when(text.rlike(X.PRIVACY_ON), False)


def privacy_sink(at: str, schema: StructType, key: str, order: list[str], toggle: Column) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes the rows of each micro-batch to `at`/out with `paused`, the state before each, and `late`.

    A micro-batch is windowed by key; the state that earlier batches left comes from a table to which each batch adds the
    last toggle and last place of its keys, under its own number, so that a batch delivered again replaces itself. No key's
    rows are held in one object. A row is `late` if its place is before one that an earlier batch has seen: it gets the
    state of its arrival and is marked, not dropped.
    """
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    place = F.struct(*order)
    known = f"k {kinds[key]}, seen struct<{', '.join(f'{c}:{kinds[c]}' for c in order)}>, last boolean"

    def sink(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        session.createDataFrame([], known).write.mode("overwrite").parquet(f"{at}/seen/batch=-1")  # so that there is a table to read
        before = session.read.schema(f"{known}, batch int").option("basePath", f"{at}/seen").parquet(f"{at}/seen").where(F.col("batch") < number)
        state = before.groupBy("k").agg(F.max("seen").alias("seen"), F.max_by("last", F.when(F.col("last").isNotNull(), F.col("batch"))).alias("last"))
        rows = batch.withColumn("__toggle", toggle)
        own = F.last("__toggle", ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        joined = rows.withColumn("__own", own).join(state, F.col(key) == F.col("k"), "left")
        out = joined.select(*batch.columns, F.coalesce("__own", "last", F.lit(False)).alias("paused"), F.coalesce(place < F.col("seen"), F.lit(False)).alias("late"))
        out.write.mode("overwrite").parquet(f"{at}/out/batch={number}")
        ends = rows.groupBy(F.col(key).alias("k")).agg(F.max(place).alias("seen"), F.max_by("__toggle", F.when(F.col("__toggle").isNotNull(), place)).alias("last"))
        ends.write.mode("overwrite").parquet(f"{at}/seen/batch={number}")

    return sink


def run_privacy(spark: SparkSession, path: str, key: str, order: list[str], toggle: Column) -> DataFrame:
    """The rows of a table, read as a stream over what is there now, with `paused` and `late`."""
    at = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(f"{path}*")  # as a pattern, it may be a file or a folder
    rows.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(privacy_sink(at, schema, key, order, toggle)).start().awaitTermination()
    return spark.read.option("basePath", f"{at}/out").parquet(f"{at}/out").drop("batch")


def receipt_stream(events: DataFrame) -> DataFrame:
    """The smallest event of each (user, type); grouping state keeps repeats out."""
    return events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


def run_to_end(spark: SparkSession, path: str, build: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """Run a stream over what is there now and return what its sink holds.

    The sink writes each micro-batch to a folder named by its number, so that a batch delivered again replaces itself. State
    and output are kept in the shared folder that the session names for checkpoints.
    """
    at = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    frame = build(spark.readStream.schema(schema).parquet(f"{path}*"))  # as a pattern, it may be a file or a folder
    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    flow = frame.writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(sink).start()
    flow.awaitTermination()
    out = spark.read.option("basePath", f"{at}/out").parquet(f"{at}/out")
    keys = columns[:-1]  # later batches replace what earlier ones said of a key
    out = out.groupBy(*keys).agg(F.max_by(columns[-1], "batch").alias(columns[-1]))
    return out.select(*columns)

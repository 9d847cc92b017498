"""Streaming ingest: new rows are searched against a database as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, minutes: int = 60, late_minutes: int = 10) -> DataFrame:
    """Events by type in tumbling windows; late ones count until the watermark passes."""
    return events.withWatermark("ts", f"{late_minutes} minutes").groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    ).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def ingest(spark: SparkSession, source: str, schema, each: Callable[[DataFrame, int], None], checkpoint: str, file_format: str = "parquet", pattern: str | None = None) -> None:
    """Hand every new file's rows to ``each`` once, in micro-batches, until none is left."""
    reader = spark.readStream.format(file_format).schema(schema)
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    stream = reader.load(source).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()

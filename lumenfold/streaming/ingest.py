"""Structured Streaming: file ingest, sessions, deduplication and counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, folder: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def session_counts(events: DataFrame, ts: str, by: list[str], gap: str, lateness: str) -> DataFrame:
    """Gap sessions; equal to the batch result once the watermark has passed."""
    rows = events.withWatermark(ts, lateness)
    return rows.groupBy(*by, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), "n")


def once_each(events: DataFrame, key: str, ts: str, lateness: str) -> DataFrame:
    """Events without repetitions within the watermark."""
    return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def pending(events: DataFrame, by: str, delta: str) -> DataFrame:
    """Running counters, for update mode."""
    return events.groupBy(by).agg(F.sum(delta).alias("pending"))


def ingest(events: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], every: str | None = None) -> StreamingQuery:
    """Micro-batches to ``write``; everything that is there and then an end, or one batch every so often."""
    out = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()

"""The stateless parts under Structured Streaming, and a burst detector with a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_items(spark: SparkSession, path: str, schema, fmt: str = "json", files: int = 100) -> DataFrame:
    """A stream of landed files; a batch takes at most ``files`` of them."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(path)


def append(stream: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Runs ``step`` on every batch and appends Parquet; restarts continue from the checkpoint."""
    return step(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


def window_counts(events: DataFrame, by: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and key; windows close once the watermark has passed them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), by).agg(F.count("*").alias("n"))

"""Incremental decode and load: each micro-batch of raw rows becomes one batch.

A batch's id is made of its content, so a micro-batch that is replayed after a failure is answered with a no-op.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

RAW = "row_id string, sku string, title string"


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Raw CSV files as they arrive."""
    return spark.readStream.schema(RAW).option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(path)


def start(raw: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Call handle with every micro-batch that has rows. once: process what is there and stop."""

    def each(df: DataFrame, n: int) -> None:
        if not df.isEmpty():
            handle(df, n)

    writer = raw.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()

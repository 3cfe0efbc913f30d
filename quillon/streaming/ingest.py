"""Ingest as a stream: deliveries once, snapshots of the latest state, counts in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def once(stream: DataFrame, key: str, at: str, delay: str = "1 day") -> DataFrame:
    """Deliveries of a stream, repeated ones within ``delay`` of the first dropped; state is kept no longer."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, by: list[str], window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """(start, end, by..., n): rows of each window of event time, once no later row can come."""
    counted = stream.withWatermark(at, delay).groupBy(F.window(at, window), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def append_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each batch to a table under ``path``; a batch that is replayed replaces what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

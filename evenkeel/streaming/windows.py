"""Collecting traces by Structured Streaming, and sealing a window as a batch at a fixed watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.window import classify


def collect(source: DataFrame, path: str, checkpoint: str, key: str = "event_id", delay: str = "1 hour", time: str = "ts"):
    """Appends each row once to ``path`` (all that is available now); repeated deliveries of a key within ``delay`` are dropped."""
    rows = source.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def seal(collected: DataFrame, start: str, end: str, watermark: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the sealed window, late rows, which a next revision takes up)."""
    marked = classify(collected, start, end, watermark)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason = 'late'").drop("reason")

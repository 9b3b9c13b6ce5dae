"""Sealed event-time windows: half-open interval, watermark, sample; no unbounded query."""

from pyspark.sql import DataFrame, functions as F


def classify(events: DataFrame, start: str, end: str, watermark: str, time: str = "ts", done: str = "completed_at") -> DataFrame:
    """``events`` with ``reason``: why a row is outside the window (the first rule that fails), null inside."""
    at = lambda s: F.to_timestamp_ntz(F.lit(s))
    reason = F.when(F.col(time) < at(start), "before-window").when(F.col(time) >= at(end), "after-window").when(F.col(done) > at(watermark), "late")
    return events.withColumn("reason", reason)

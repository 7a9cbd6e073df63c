"""Structured Streaming twins of the batch metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rates import failure_rate
from ..operators.telemetry import composite_margin, run_metrics


def running_margin(steps: DataFrame) -> DataFrame:
    """The margin of each run so far (update mode): every aggregate is mergeable."""
    return composite_margin(run_metrics(steps))


def windowed_failure_rate(points: DataFrame, ts: str, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Failure rate of each event-time window; rows later than the watermark drop."""
    held = points.withWatermark(ts, late) if points.isStreaming else points
    return failure_rate(held.withColumn("win", F.window(ts, length, slide)), ["win"])


def once_per_job(results: DataFrame, ts: str, job: str = "job_id", late: str = "10 minutes") -> DataFrame:
    """A retried job delivers its result once."""
    if results.isStreaming:
        return results.withWatermark(ts, late).dropDuplicatesWithinWatermark([job])
    return results.dropDuplicates([job])


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs closed by a silent gap."""
    held = events.withWatermark(ts, late) if events.isStreaming else events
    return held.groupBy(F.session_window(ts, gap).alias("session"), key).agg(F.count("*").alias("n"))

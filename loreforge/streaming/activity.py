"""Windowed activity counts over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """The stream with its event time as a timestamp and a watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def daily(events: DataFrame, by: list[str] | None = None, *, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """by, day, n over tumbling days; rows later than the watermark are dropped in append mode."""
    counts = timed(events, ts, late).groupBy(F.window(ts, "1 day"), *(by or [])).agg(F.count("*").alias("n"))
    return counts.select(*(by or []), F.to_date("window.start").alias("day"), "n")


def sliding(events: DataFrame, width: str, slide: str, *, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """start, end, n over sliding windows."""
    counts = timed(events, ts, late).groupBy(F.window(ts, width, slide)).agg(F.count("*").alias("n"))
    return counts.select("window.start", "window.end", "n")


def sessions(events: DataFrame, by: str, gap: str = "30 minutes", *, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """by, start, end, n of runs of events with no gap longer than that."""
    counts = timed(events, ts, late).groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n"))
    return counts.select(by, "session_window.start", "session_window.end", "n")


def deduplicated(events: DataFrame, key: str, *, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Each event once, as far as the watermark reaches."""
    return timed(events, ts, late).dropDuplicatesWithinWatermark([key])

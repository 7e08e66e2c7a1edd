"""Streams: limits, interval counts, incremental take-up and the state of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sliding import limiter, login_limiter  # noqa: F401  the limits over sliding windows
from .taken import incremental  # noqa: F401  take-up that remembers


def interval_counts(events: DataFrame, ts: str, every: str, grace: str, *by: str) -> DataFrame:
    """Events per interval and ``by``; an event later than ``grace`` behind the newest is dropped."""
    w = F.window(ts, every)
    return events.withWatermark(ts, grace).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def first_seen(events: DataFrame, ts: str, grace: str, *by: str) -> DataFrame:
    """Each key's first event within the watermark."""
    return events.withWatermark(ts, grace).dropDuplicatesWithinWatermark(list(by))


def activity(events: DataFrame, key: str, ts: str, gap: str, grace: str) -> DataFrame:
    """Bursts of a key's events with less than ``gap`` between them."""
    w = F.session_window(ts, gap)
    return events.withWatermark(ts, grace).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_states(events: DataFrame, run: str, ts: str, status: str) -> DataFrame:
    """The last status of every run (complete or update mode)."""
    return events.groupBy(run).agg(F.max_by(status, ts).alias("status"), F.min(ts).alias("first"), F.max(ts).alias("last"))

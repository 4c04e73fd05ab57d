"""Event-time windows, for tables and streams alike: an extension beyond the review engine's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(events: DataFrame, at: str, lateness: str | None) -> DataFrame:
    return events.withWatermark(at, lateness) if lateness and events.isStreaming else events


def tumbling(events: DataFrame, keys: list[str], at: str, width: str, slide: str | None = None, lateness: str | None = None) -> DataFrame:
    """keys, start, n: events in each window of a width (that starts every `slide`, where one is given)."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return _late(events, at, lateness).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, keys: list[str], at: str, gap: str, lateness: str | None = None) -> DataFrame:
    """keys, start, last, n: a session goes on while its next event comes within the gap."""
    w = F.session_window(at, gap)
    found = _late(events, at, lateness).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), F.max(at).alias("last"))
    return found.select(*keys, F.col("w.start").alias("start"), "last", "n")

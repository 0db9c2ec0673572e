"""Event-time windows over a stream or a table; an extension over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, at: str, by: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start (epoch seconds), by, n, total: a stream waits ``late`` for late rows; on a table all rows count."""
    src = events.withWatermark(at, late) if events.isStreaming else events
    g = src.groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))
    return g.select(F.unix_timestamp("window.start").alias("start"), by, "n", "total")

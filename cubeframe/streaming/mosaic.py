"""Streaming counterpart of the calendar mosaic: tumbling windows that start with the caller's date."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_sums(stream: DataFrame, keys: list[str], value: str, start: datetime, days: int, late: str = "2 days") -> DataFrame:
    """keys, win_start, n, total for a stream with a ``ts`` column; windows are anchored at ``start``, not at the epoch."""
    shift = int((start - datetime(1970, 1, 1)).total_seconds()) % (86400 * days)
    win = F.window("ts", f"{days} days", None, f"{shift} seconds")
    return stream.withWatermark("ts", late).groupBy(*keys, win.alias("w")).agg(F.count(value).alias("n"), F.sum(value).alias("total")).select(*keys, F.col("w.start").alias("win_start"), "n", "total")

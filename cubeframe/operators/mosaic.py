"""Calendar windows and exact median mosaics. The time axis depends on start, end and width only."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK_CLASSES = [0, 1, 3, 7, 8, 9, 10]


def n_windows(start: datetime, end: datetime, days: int) -> int:
    return max(1, -(-int((end - start).total_seconds()) // (86400 * days)))


def window_index(ts: Column, start: datetime, end: datetime, days: int) -> Column:
    """0 .. n - 1; windows are half-open but for the last, which ends with ``end``."""
    passed = F.floor(F.timestamp_diff("SECOND", F.lit(start).cast("timestamp_ntz"), ts) / (86400 * days))
    return F.least(passed, F.lit(n_windows(start, end, days) - 1)).cast("int")


def within(ts: Column, start: datetime, end: datetime) -> Column:
    return ts.between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))


def spine(keys: DataFrame, n: int) -> DataFrame:
    """Every key with every window."""
    return keys.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("win"))


def median_mosaic(obs: DataFrame, keys: list[str], values: list[str], start: datetime, end: datetime, days: int, nodata: int = 0) -> DataFrame:
    """keys, win and the truncated exact median of each value; empty windows and all-missing medians are ``nodata``."""
    n = n_windows(start, end, days)
    win = F.when(within(F.col("ts"), start, end), window_index(F.col("ts"), start, end, days))
    found = obs.withColumn("win", win).groupBy(*keys, "win").agg(*[F.median(v).cast("int").alias(v) for v in values])
    # one read: what lies outside the range keeps its key's axis alive, as the row without a window
    by = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(F.col("win").isNotNull(), F.struct("win", F.struct(*values))))).alias("found"))
    out = by.select(*keys, "found", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("win"))
    return out.select(*keys, "win", *[F.coalesce(F.col("found")[F.col("win")][v], F.lit(nodata)).alias(v) for v in values])


def wide(obs: DataFrame, bands: list[str], value: Column) -> DataFrame:
    """One nullable column for each band."""
    return obs.select("*", *[F.when(F.col("band") == b, value).alias(b) for b in bands])


def acquisition_windows(times: DataFrame, key: str, start: datetime, days: int) -> DataFrame:
    """key, ts, win: gap-driven windows. A time past the open window's end opens the next, one step on.

    Each key's distinct times (a cube's time axis, not its pixels) are walked once, in order, within the plan.
    """
    step = F.lit(86400 * days)
    at = lambda t: F.timestamp_diff("SECOND", F.lit(start).cast("timestamp_ntz"), t)
    axis = times.groupBy(key).agg(F.array_sort(F.collect_set(F.col("ts").cast("timestamp_ntz"))).alias("axis"))
    begin = F.struct(step.cast("long").alias("end"), F.lit(0).alias("win"), F.array().cast("array<struct<ts:timestamp_ntz,win:int>>").alias("out"))

    def walk(s: Column, t: Column) -> Column:
        past = at(t) > s["end"]
        win = F.when(past & (F.size(s["out"]) > 0), s["win"] + 1).otherwise(s["win"])
        return F.struct(F.when(past, s["end"] + step).otherwise(s["end"]).alias("end"), win.alias("win"), F.concat(s["out"], F.array(F.struct(t.alias("ts"), win.alias("win")))).alias("out"))

    found = axis.select(key, F.explode(F.aggregate("axis", begin, walk, lambda s: s["out"])).alias("w"))
    return found.select(key, "w.ts", "w.win")


def pixel_indices(spark: SparkSession, obs: DataFrame, start: datetime, end: datetime, days: int) -> DataFrame:
    """The flagship plan: mask, calendar median of each band, complete axis, NDVI."""
    from cubeframe.functions.bands import masked

    bands = ["B04", "B08"]
    clear = wide(obs, bands, masked(F.col("dn"), F.col("scl"), MASK_CLASSES))
    out = median_mosaic(clear, ["pixel"], bands, start, end, days)
    n, r = F.col("B08").cast("double"), F.col("B04").cast("double")
    return out.withColumn("ndvi", F.round(F.try_divide(n - r, n + r), 6))

"""Pixels as rows: nearest-neighbour resampling onto a reference grid, verdicts on outputs, class legends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resample_nearest(src: DataFrame, grid: DataFrame, keys: list[str], value: str, ratio: float, shift: tuple[float, float] = (0.0, 0.0), nodata: int = 0) -> DataFrame:
    """``grid``'s pixels (``keys``, row, col) with the value of the source pixel that holds their centre.

    ``ratio``: size of a target pixel in source pixels; ``shift``: (rows, columns) of the target's origin in the source.
    An equi-join on the source's row and column; pixels outside the source get ``nodata``.
    """
    at = lambda c, s: F.floor((F.col(c) + 0.5) * ratio + s).cast("int")
    here = grid.select(*keys, "row", "col", at("row", shift[0]).alias("_row"), at("col", shift[1]).alias("_col"))
    there = src.select(*keys, F.col("row").alias("_row"), F.col("col").alias("_col"), value)
    out = here.join(there, [*keys, "_row", "_col"], "left")
    return out.select(*keys, "row", "col", F.coalesce(value, F.lit(nodata)).alias(value))


def verdict(df: DataFrame, keys: list[str], value: str, nodata: Column) -> DataFrame:
    """Least and greatest value, and the share of pixels that are ``nodata``."""
    void = F.coalesce(F.col(value) == nodata, F.lit(True))
    return df.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.round(F.avg(void.cast("int")), 6).alias("nodata_share"))


def legend(classes: DataFrame, name: str, colour: Column) -> DataFrame:
    """name, code (rank of the name from 0), red, green, blue: one row for each class; classes are few."""
    part = lambda k: F.conv(F.substring("_hex", k, 2), 16, 10).cast("int")
    seen = classes.select(name, colour.alias("_hex")).distinct()
    code = (F.row_number().over(Window.orderBy(name)) - 1).alias("code")
    return seen.select(name, code, part(1).alias("red"), part(3).alias("green"), part(5).alias("blue"))


def first_months(df: DataFrame, ts: str, months: int) -> DataFrame:
    """Rows earlier than ``months`` after the day of the first; the first comes from one small aggregate."""
    first = df.agg(F.add_months(F.to_date(F.min(ts)), months).cast("timestamp").alias("_end"))
    return df.join(F.broadcast(first), F.col(ts) < F.col("_end")).drop("_end")  # one row

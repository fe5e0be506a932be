"""A cube from pixel rows: offset, reference grid, tile merge, mask, calendar median, as one plan."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeframe.functions.bands import is_reflectance, masked, with_offset
from cubeframe.operators.mosaic import MASK_CLASSES, median_mosaic


def dominant_crs(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ref: the reference system that most of a cube's pixels come in, the greatest of equals."""
    n = pixels.groupBy(*keys, "crs").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(F.max_by("crs", F.struct("n", "crs")).alias("ref"))


def merged(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """One value for each pixel, time and band: the first valid one, tiles in the cube's own system first, then by seq."""
    native = pixels.join(dominant_crs(pixels, keys), keys).withColumn("foreign", F.col("crs") != F.col("ref"))
    first = F.min_by("dn", F.when(F.col("dn").isNotNull(), F.struct("foreign", "seq")))
    return native.groupBy(*keys, "row", "col", "ts", "band").agg(first.alias("dn"))


def build(pixels: DataFrame, keys: list[str], bands: list[str], start: datetime, end: datetime, days: int, mask: str = "SCL", classes: list[int] | None = None) -> DataFrame:
    """keys, row, col, win and the bands: the calendar mosaic of ``pixels`` (keys, row, col, ts, band, dn, crs, offset, nodata, seq).

    Digital numbers are offset first, then merged, masked and reduced; every window of every pixel is there, 0 where
    nothing is left. Rows are on the reference grid already (see ``raster.resample_nearest``).
    """
    dn = F.nullif("dn", F.coalesce("nodata", F.lit(0)))
    dn = F.when(is_reflectance(F.col("band")), with_offset(dn, F.coalesce("offset", F.lit(0)))).otherwise(dn)
    one = merged(pixels.withColumn("dn", F.when(F.col("dn") != F.coalesce("nodata", F.lit(0)), dn)), keys)
    wide = one.groupBy(*keys, "row", "col", "ts").agg(*[F.max(F.when(F.col("band") == b, F.col("dn"))).alias(b) for b in (*bands, mask)])
    clear = wide.select(*keys, "row", "col", "ts", *[masked(F.col(b), F.col(mask), MASK_CLASSES if classes is None else classes).alias(b) for b in bands])
    return median_mosaic(clear, [*keys, "row", "col"], bands, start, end, days)

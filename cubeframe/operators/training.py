"""From cubes to training rows and from predictions to bands: stacking, cropping, features by label, outputs merged."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeframe.functions import geometry as G
from cubeframe.functions.geo import pixel_centre
from cubeframe.operators.series import flatten

Step = Callable[[DataFrame], DataFrame]


def run_steps(df: DataFrame, steps: list[tuple[Callable[..., DataFrame], dict]]) -> DataFrame:
    """Each (operator, arguments) applied to what the one before it gives: one plan."""
    return reduce(lambda d, s: s[0](d, **s[1]), steps, df)


def features(df: DataFrame, adapter: Step | None = None, steps: list[tuple[Callable[..., DataFrame], dict]] | None = None) -> DataFrame:
    """The one definition of features for training and inference: the adapter's, else the steps', else ``df`` itself."""
    return adapter(df) if adapter is not None else run_steps(df, steps or [])


def stacked(pixels: DataFrame, keys: list[str], bands: list[str], grid: str = "grid") -> DataFrame:
    """keys, row, col and a column for each band; reading a cube whose bands are on different grids fails."""
    grids = pixels.where(F.col("band").isin(bands)).groupBy(*keys, "row", "col").agg(
        *[F.max(F.when(F.col("band") == b, F.col("dn"))).alias(b) for b in bands], F.min(grid).alias("low"), F.max(grid).alias("high")
    )
    cubes = pixels.where(F.col("band").isin(bands)).groupBy(*keys).agg((F.min(grid) == F.max(grid)).alias("same"))
    said = F.concat_ws(" ", F.lit("bands of different grids:"), *[F.col(k).cast("string") for k in keys])
    fine = grids.join(cubes, keys).where(F.when(F.coalesce("same", F.lit(True)), True).otherwise(F.raise_error(said)))
    return fine.select(*keys, "row", "col", *bands)


def crop(pixels: DataFrame, rings: Column, x: Column, y: Column) -> DataFrame:
    """Pixels whose centre lies within the polygon: an even number of edges to its right means outside.

    ``rings`` may be a column of the row or a literal; edges are half open, so a centre on a shared edge is in one polygon only.
    """
    def crossed(ring: Column) -> Column:
        after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
        cut = lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < p["x"] + F.try_divide((y - p["y"]) * (q["x"] - p["x"]), q["y"] - p["y"]))
        return F.size(F.filter(F.zip_with(ring, after, lambda p, q: F.coalesce(cut(p, q), F.lit(False))), lambda b: b))

    xmin, ymin, xmax, ymax = G.bounds(rings)
    times = F.aggregate(F.transform(rings, crossed), F.lit(0), lambda a, b: a + b)
    return pixels.where(x.between(xmin, xmax) & y.between(ymin, ymax) & (times % 2 == 1))


def training_rows(cubes: DataFrame, labels: DataFrame, key: str, order: str, values: list[str], origin: tuple[Column, Column], size: Column) -> DataFrame:
    """key, row, col, x, y, features and label: pixels of labelled cubes that have any value, at their centres.

    ``cubes``: key, row, col, the origin's columns, ``order`` and values; ``labels``: key, label.
    """
    where = cubes.withColumns(dict(zip(("x", "y"), pixel_centre(*origin, F.col("col"), F.col("row"), size), strict=True)))
    return flatten(where, [key, "row", "col", "x", "y"], order, values).join(labels.select(key, "label"), key)


def aggregated(rows: DataFrame, key: str, how: str | Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """key, label, features: as they are; one row of medians for each key ("median_per_id"); or by a function of a key's rows.

    Medians are taken position by position, so that no key's rows are held in one place; a function gets all of a key's rows.
    """
    if how is None:
        return rows.select(key, "label", "features")
    if how == "median_per_id":
        one = rows.select(key, "label", F.posexplode("features").alias("at", "v")).groupBy(key, "label", "at").agg(F.median("v").alias("v"))
        return one.groupBy(key, "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("features"))
    if not callable(how):
        raise ValueError(f"no aggregate {how!r}")
    kinds = rows.select(key, "label").schema
    schema = T.StructType([*kinds.fields, T.StructField("features", T.ArrayType(T.DoubleType()))])
    return rows.select(key, "label", "features").groupBy(key).applyInPandas(how, schema)


def output_bands(predicted: DataFrame, keys: list[str], prediction: str, kind: str) -> DataFrame:
    """keys, band (from 1), value: a row for each member of a prediction; a single number is band 1."""
    many = isinstance(predicted.schema[prediction].dataType, T.ArrayType)
    p = F.col(prediction) if many else F.array(prediction)
    return predicted.select(*keys, F.posexplode(p).alias("at", "v")).select(*keys, (F.col("at") + 1).alias("band"), F.col("v").cast(kind).alias("value"))


def scattered(grid: DataFrame, predicted: DataFrame, keys: list[str], value: str, nodata: float) -> DataFrame:
    """Every pixel of ``grid`` with its prediction, ``nodata`` where there is none; ``keys`` are unique in both."""
    return grid.select(*keys).join(predicted.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit(nodata)))


def merge_outputs(outputs: DataFrame, value: str, nodata: Column, to_dominant: bool = False) -> DataFrame:
    """crs, x, y, value: of outputs (seq, crs, x, y, value) on one grid the first that is not ``nodata``, the least value of equal seq.

    All have one reference system, or reading fails; with ``to_dominant`` those in the most frequent one (of equals the
    greatest) are merged, and the others have to be warped first.
    """
    n = outputs.groupBy("crs").agg(F.count(F.lit(1)).alias("n"))
    if to_dominant:
        ref = n.agg(F.max_by("crs", F.struct("n", "crs")).alias("ref"))
    else:
        ref = n.agg(F.count(F.lit(1)).alias("n"), F.max("crs").alias("ref"), F.array_join(F.array_sort(F.collect_list("crs")), ", ").alias("all"))
        ref = ref.select(F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("outputs of several reference systems: "), F.col("all")))).otherwise(F.col("ref")).alias("ref"))
    one = outputs.join(F.broadcast(ref), F.col("crs") == F.col("ref"))  # one row
    first = F.min_by(value, F.when(F.col(value) != nodata, F.struct("seq", value)))
    return one.groupBy("crs", "x", "y").agg(F.coalesce(first, F.min(nodata)).alias(value))

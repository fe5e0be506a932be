"""Readers: observations as a pixel time series, tile boxes, feature collections and asset lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Which event type plays which spectral band.
BANDS = {"view": "B02", "purchase": "B03", "click": "B04", "error": "B08", "signup": "B11"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """pixel, band, ts, dn, scl: one row for each reading; dn null where there is none."""
    band = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in BANDS.items()])
    return table(spark, folder, "events").select(
        F.col("user_id").alias("pixel"),
        band.alias("band"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.nullif(F.floor(F.col("value") * 100).cast("int"), F.lit(0)).alias("dn"),
        (F.get_json_object("props", "$.k").cast("int") % 12).alias("scl"),
        F.col("event_id").alias("seq"),
    )


FEATURES = T.StructType([T.StructField("features", T.ArrayType(T.StructType([T.StructField("properties", T.MapType(T.StringType(), T.StringType())), T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))]))])))])


def feature_collection(spark: SparkSession, path: str) -> DataFrame:
    """properties, rings (array of arrays of (x, y)) and the bounding box of every polygon of GeoJSON files."""
    one = spark.read.schema(FEATURES).json(path, multiLine=True).select(F.explode("features").alias("f"))
    rings = F.transform("f.geometry.coordinates", lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    flat = F.flatten("rings")
    edge = lambda f, axis: f(F.transform(flat, lambda p: p[axis]))
    return one.select("f.properties", rings.alias("rings")).select("*", edge(F.array_min, "x").alias("xmin"), edge(F.array_min, "y").alias("ymin"), edge(F.array_max, "x").alias("xmax"), edge(F.array_max, "y").alias("ymax"))


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path and length of files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length")

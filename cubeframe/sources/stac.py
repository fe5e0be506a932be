"""Items of a spatio-temporal asset catalog: to rows, from rows, to asset rows, extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeframe.functions import geometry as G
from cubeframe.functions.bands import band_role, is_reflectance, mgrs_epsg
from cubeframe.functions.names import media_type

ITEM = (
    "type string, id string, bbox array<double>, properties struct<datetime string, `eo:cloud_cover` double, `proj:epsg` int, platform string>, "
    "assets map<string, struct<href string, type string, roles array<string>, scale double, offset double, nodata int>>"
)
#: Fixed value: digital numbers to reflectance.
SCALE = 0.0001


def items(tiles: DataFrame, reference: str = "B08") -> DataFrame:
    """id, item (JSON): one item for each tile (id, satellite, ts, folder, files, cloud_cover, offset, nodata, bounds)."""
    band = lambda f: F.regexp_extract(f, r"([^/]*?)\.[^./]*$", 1)

    def asset(f: Column) -> Column:
        refl = is_reflectance(band(f))
        return F.struct(
            F.concat_ws("/", "folder", f).alias("href"),
            media_type(f).alias("type"),
            F.array(band_role(band(f), reference)).alias("roles"),
            F.when(refl, F.lit(SCALE)).alias("scale"),
            F.when(refl, F.round(F.col("offset") * SCALE, 6)).alias("offset"),
            F.col("nodata").alias("nodata"),
        )

    files = F.array_sort(F.split("files", ","))
    assets = F.map_from_arrays(F.transform(files, band), F.transform(files, asset))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    properties = F.struct(stamp.alias("datetime"), F.col("cloud_cover").alias("eo:cloud_cover"), mgrs_epsg(F.col("id")).alias("proj:epsg"), F.col("satellite").alias("platform"))
    box = F.array(*[F.col(c).cast("double") for c in ("xmin", "ymin", "xmax", "ymax")])
    return tiles.select("id", F.to_json(F.struct(F.lit("Feature").alias("type"), "id", box.alias("bbox"), properties.alias("properties"), assets.alias("assets"))).alias("item"))


def rows(found: DataFrame) -> DataFrame:
    """The catalog's columns from ``item``: offsets go back from reflectance to digital numbers, as the reflectance bands have them."""
    i = found.select(F.from_json("item", ITEM).alias("i"))
    assets = F.map_entries("i.assets")
    offset = F.array_min(F.transform(assets, lambda a: F.round(F.try_divide(a["value"]["offset"], a["value"]["scale"])).cast("int")))
    names = F.array_sort(F.transform(assets, lambda a: F.regexp_extract(a["value"]["href"], "([^/]*)$", 1)))
    return i.select(
        "i.id",
        F.col("i.properties.platform").alias("satellite"),
        F.to_timestamp("i.properties.datetime").cast("timestamp_ntz").alias("ts"),
        F.array_join(names, ",").alias("files"),
        F.col("i.properties.eo:cloud_cover").alias("cloud_cover"),
        F.coalesce(offset, F.lit(0)).alias("offset"),
        F.coalesce(F.array_min(F.transform(assets, lambda a: a["value"]["nodata"])), F.lit(0)).alias("nodata"),
        *[F.get("i.bbox", F.lit(k)).alias(c) for k, c in enumerate(("xmin", "ymin", "xmax", "ymax"))],
    )


def asset_rows(found: DataFrame, bands: list[str]) -> DataFrame:
    """id, band, href, wkt: a row for each item and requested band that it has."""
    i = found.select(F.from_json("item", ITEM).alias("i")).select("i.id", "i.bbox", F.explode("i.assets").alias("band", "a")).where(F.col("band").isin(bands))
    at = lambda k: F.get("bbox", F.lit(k)).cast("string")
    corner = lambda x, y: F.concat_ws(" ", at(x), at(y))
    wkt = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", corner(0, 1), corner(2, 1), corner(2, 3), corner(0, 3), corner(0, 1)), F.lit("))"))
    return i.select("id", "band", "a.href", wkt.alias("wkt"))


def extent(tiles: DataFrame) -> DataFrame:
    """One row: least and greatest bounds and times."""
    return tiles.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), F.min("ts").alias("start"), F.max("ts").alias("end"))


def moved_items(found: DataFrame, old: str, new: str) -> DataFrame:
    """Items as lines of JSON with their hrefs under another root."""
    return found.select(F.regexp_replace("item", f'"href":"{old}', f'"href":"{new}').alias("value"))


def polygons(geojson: DataFrame) -> DataFrame:
    """id, rings from a column of GeoJSON geometries (id, geometry): polygons as they are, others left out."""
    kind = "type string, coordinates array<array<array<double>>>"
    g = geojson.where(F.get_json_object("geometry", "$.type") == "Polygon").select("id", F.from_json("geometry", kind).alias("g"))
    ring = lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return g.select("id", F.transform("g.coordinates", ring).alias("rings")).where(G.polygonal(F.col("rings")))

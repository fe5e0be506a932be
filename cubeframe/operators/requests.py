"""Requests: work units, identity stamps, declarations, archive checks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeframe.operators.catalog import guard_unique

#: The newest version of a declaration that is understood, and its fields with what stands for an absent one.
VERSION = 1
FIELDS = {"offset": 0, "nodata": 0, "scale": 0.0001}


def cloud_filter(items: DataFrame, most: float, inclusive: bool = True) -> DataFrame:
    """Items up to (or, as some catalogs count, below) that cloud cover; unknown cover goes."""
    return items.where(F.col("cloud_cover") <= most if inclusive else F.col("cloud_cover") < most)


def refined(items: DataFrame, meets: Column, most: float) -> DataFrame:
    """Items under the cloud cover that meet the region; reading fails if an id stands twice among them."""
    return guard_unique(cloud_filter(items, most).where(meets), "id")


def identity(request: dict[str, Column]) -> Column:
    """A request's SHA-256 over its sorted names and values; null and an empty text differ."""
    pair = lambda k: F.concat(F.lit(f"{len(k)}:{k}="), F.coalesce(F.concat(F.lit("'"), request[k].cast("string")), F.lit("-")))
    return F.sha2(F.concat_ws("\n", *map(pair, sorted(request))), 256)


def to_do(wanted: DataFrame, stamps: DataFrame, key: str) -> DataFrame:
    """``wanted`` (key, identity) that no stamp (key, identity) matches: what is older or newer makes no difference."""
    return wanted.join(stamps.select(key, "identity"), [key, "identity"], "left_anti")


def work_units(pairs: DataFrame, shapes: DataFrame, key: str) -> DataFrame:
    """key, seq, tiles, first, last: the manifest of shapes (key, seq) with their tiles (key, id, ts), in the shapes' order.

    Shapes without a tile get no unit; reading fails where there is no unit at all.
    """
    units = pairs.select(key, "id", "ts").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("tiles"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    units = shapes.select(key, "seq").join(units, key)
    n = units.agg(F.count(F.lit(1)).alias("n")).select(F.when(F.col("n") == 0, F.raise_error(F.lit("no work units"))).otherwise(F.lit(True)).alias("fine"))
    return n.join(units, F.col("fine"), "left").select(key, "seq", "tiles", "first", "last")  # one row


def declaration(text: Column) -> Column:
    """A stored declaration (JSON) as a struct; absent fields get their defaults, an unknown field or newer version fails."""
    names = F.json_object_keys(text)
    strange = F.array_except(names, F.array(*map(F.lit, ["version", *FIELDS])))
    made = F.from_json(text, "version int, offset int, nodata int, scale double")
    full = F.struct(*[F.coalesce(made[k], F.lit(v)).alias(k) for k, v in FIELDS.items()])
    return (
        F.when(names.isNull(), F.when(text.isNotNull(), F.raise_error(F.concat(F.lit("no declaration: "), text))))
        .when(F.size(strange) > 0, F.raise_error(F.concat(F.lit("unknown fields: "), F.array_join(strange, ", "))))
        .when(F.coalesce(made["version"], F.lit(VERSION)) > VERSION, F.raise_error(F.lit("declaration of a newer version")))
        .otherwise(full)
    )


def resolved(asked: Column, stamp: Column, in_process: bool) -> Column:
    """What was asked for, else the stamp, else the defaults, but these only for rows that never were in a file."""
    last = F.lit(json.dumps(FIELDS)) if in_process else F.raise_error(F.lit("rows without a declaration"))
    return declaration(F.when(asked.isNotNull(), asked).when(stamp.isNotNull(), stamp).otherwise(last))


def archive_check(tiles: DataFrame, group: str, bands: list[str]) -> DataFrame:
    """Per group: items, tiles, whether there is one tile only, bands present and missing, offsets, span of days."""
    names = lambda c: F.array_join(F.array_sort(c), ",")
    some = tiles.groupBy(group).agg(F.count(F.lit(1)).alias("items"), F.count_distinct("tile").alias("tiles"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.collect_set("offset").alias("offsets"))
    have = tiles.select(group, F.explode(F.split("files", ",")).alias("f")).select(group, F.regexp_extract("f", r"([^/]*?)\.[^./]*$", 1).alias("band")).distinct()
    have = have.where(F.col("band").isin(bands)).groupBy(group).agg(F.collect_list("band").alias("have"))
    found = F.coalesce("have", F.array().cast("array<string>"))
    return some.join(have, group, "left").select(
        group, "items", "tiles", (F.col("tiles") == 1).alias("single_tile"), names(found).alias("present"), names(F.array_except(F.array(*map(F.lit, bands)), found)).alias("missing"),
        F.array_join(F.transform(F.array_sort("offsets"), lambda o: o.cast("string")), ",").alias("offsets"), F.date_diff("last", "first").alias("days"),
    )

"""Registered polygon queries: diamonds of any place and size, whose common areas SQL can give by turning them into boxes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from cubeframe.functions import geometry as G
from cubeframe.operators import spatial as P
from cubeframe.plans.queries import query
from cubeframe.sources.tables import table

c, lit = F.col, F.lit
#: Centre (x, y) and half width (r) of each diamond; u = x + y and v = x - y make it a box of half width r.
_A = "a AS (SELECT p_partkey AS id, (p_partkey * 37 % 360)::DOUBLE AS x, (p_partkey * 53 % 170)::DOUBLE AS y, (1 + p_size % 4)::DOUBLE AS r FROM part)"
_B = "b AS (SELECT s_suppkey AS id, (s_suppkey * 91 % 360)::DOUBLE AS x, (s_suppkey * 29 % 170)::DOUBLE AS y, (3 + s_nationkey % 5)::DOUBLE AS r FROM supplier)"
_MEET = "abs(a.x - b.x) + abs(a.y - b.y) <= a.r + b.r"
_COMMON = "(greatest(0, least(a.x + a.y + a.r, b.x + b.y + b.r) - greatest(a.x + a.y - a.r, b.x + b.y - b.r)) * greatest(0, least(a.x - a.y + a.r, b.x - b.y + b.r) - greatest(a.x - a.y - a.r, b.x - b.y - b.r)) / 2)"


def _diamonds(df, key, kx, ky, r):
    x, y = (c(key) * kx % 360).cast("double"), (c(key) * ky % 170).cast("double")
    r = r.cast("double")
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return df.select(c(key).alias("id"), F.array(F.array(point(x - r, y), point(x, y - r), point(x + r, y), point(x, y + r))).alias("rings"))


def _a(spark, d):
    return _diamonds(table(spark, d, "part"), "p_partkey", 37, 53, 1 + c("p_size") % 4)


def _b(spark, d):
    return _diamonds(table(spark, d, "supplier"), "s_suppkey", 91, 29, 3 + c("s_nationkey") % 5)


@query(f"WITH {_A}, {_B} SELECT a.id AS a_id, b.id AS b_id FROM a JOIN b ON {_MEET}")
def polygon_join(spark, d):
    return P.pairs(_a(spark, d), _b(spark, d), 8.0).select("a_id", "b_id")


@query(f"WITH {_A}, {_B} SELECT a.id AS a_id, b.id AS b_id, round({_COMMON}, 4) AS area FROM a JOIN b ON {_MEET} WHERE {_COMMON} > 0")
def field_overlay(spark, d):
    area = F.aggregate(F.transform("rings", G.ring_area), lit(0.0), lambda s, x: s + x)
    return P.overlay(_a(spark, d), _b(spark, d), 8.0, area=F.round(area, 4)).select("a_id", "b_id", "area")


@query(f"""WITH {_A}, {_B} SELECT a.id FROM a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.id <> a.id AND abs(a.x - b.x) + abs(a.y - b.y) <= b.r - a.r AND (b.r > a.r OR b.id < a.id))""")
def uncovered_cells(spark, d):
    return P.uncovered(_a(spark, d), 8.0).select("id")


@query(f"""WITH {_A}, {_B}, s AS (SELECT * FROM b WHERE id = 1)
SELECT a.id, round(100 * {_COMMON.replace('b.', 's.')} / (2 * s.r * s.r), 4) AS area_contribution FROM a JOIN s ON {_MEET.replace('b.', 's.')} WHERE a.id % 31 < 20""")
def catalog_filter(spark, d):
    day = F.timestamp_add("DAY", (c("id") % 31).cast("int"), lit(datetime(2018, 1, 1)).cast("timestamp_ntz"))
    tiles = _a(spark, d).withColumn("ts", day)
    return P.catalog_filter(tiles, _b(spark, d).where("id = 1"), datetime(2018, 1, 1), datetime(2018, 1, 20), 8.0).select("id", "area_contribution")


@query(f"""WITH {_B}, g AS (SELECT * FROM (SELECT unnest(range(-2, 20)) AS cx), (SELECT unnest(range(-2, 12)) AS cy))
SELECT DISTINCT cx || ':' || cy AS id FROM g JOIN b ON greatest(20 * cx - x, 0, x - 20 * cx - 20) + greatest(20 * cy - y, 0, y - 20 * cy - 20) <= r""")
def grid_cells(spark, d):
    return P.cells_of(_b(spark, d), 20.0).select("id")


@query(f"WITH {_A}, {_B} SELECT a.id, count(*) AS tiles FROM a JOIN b ON {_MEET} GROUP BY 1")
def cell_coverage(spark, d):
    return P.coverage(_a(spark, d), _b(spark, d), 8.0).select("id", c("n").alias("tiles"))

"""Polygons, work lists and items: hand-computed values."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cubeframe.functions import geometry as G
from cubeframe.functions import names as N
from cubeframe.operators import cube, model, spatial
from cubeframe.operators import worklists as W
from cubeframe.sources import stac


def box(x1, y1, x2, y2):
    return [[{"x": float(x), "y": float(y)} for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))]]


def test_areas():
    hole = [*box(0, 0, 4, 4), *box(1, 1, 3, 3)]
    notch = [[{"x": float(x), "y": float(y)} for x, y in ((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))]]
    assert G.common_area([box(0, 0, 2, 2), box(1, 1, 3, 3)], [box(0, 0, 1, 9)]) == pytest.approx((7, 9, 2))
    assert G.common_area([hole], [box(0, 0, 2, 2)]) == pytest.approx((12, 4, 3))
    assert G.common_area([notch], [])[0] == pytest.approx(10) and G.common_area([], []) == (0, 0, 0)
    assert not G.meet(notch, box(1.5, 3, 2.5, 4)) and G.meet(notch, box(4, 4, 5, 5)) and not G.meet(hole, box(1.5, 1.5, 2.5, 2.5))


def test_common_area_by_counting():
    r = random.Random(1)
    for _ in range(6):
        rings = [[[{"x": r.uniform(0, 10), "y": r.uniform(0, 10)} for _ in range(3)]] for _ in range(4)]

        def inside(p, x, y):
            e = G.edges(p)
            return sum(bool((y1 > y) != (y2 > y) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1)) for x1, y1, x2, y2 in e) % 2 == 1

        points = [(r.uniform(0, 10), r.uniform(0, 10)) for _ in range(4000)]
        both = sum(any(inside(p, *q) for p in rings[:2]) and any(inside(p, *q) for p in rings[2:]) for q in points) / 40
        assert G.common_area(rings[:2], rings[2:])[2] == pytest.approx(both, abs=3)


def test_catalog_filter(spark):
    rows = [("hit", box(0, 0, 1, 1), datetime(2024, 8, 10)), ("far", box(5, 5, 6, 6), datetime(2024, 8, 10)), ("early", box(0, 0, 1, 1), datetime(2024, 7, 31)), ("edge", box(0, 0, 1, 2), datetime(2024, 8, 31))]
    tiles = spark.createDataFrame(rows, f"id string, rings {G.RINGS}, ts timestamp_ntz")
    roi = spark.createDataFrame([("a", box(0, 0, 1, 1)), ("b", box(0, 0, 1, 1))], f"id string, rings {G.RINGS}")
    got = {r["id"]: r["area_contribution"] for r in spatial.catalog_filter(tiles, roi, datetime(2024, 8, 1), datetime(2024, 8, 31), 2.0).collect()}
    assert got == {"hit": 100, "edge": 100}
    empty = spatial.catalog_filter(tiles.limit(0), roi, datetime(2024, 8, 1), datetime(2024, 8, 31), 2.0)
    assert empty.count() == 0
    cells = spark.createDataFrame([("1", box(0, 0, 2, 2)), ("2", box(0, 0, 1, 1)), ("3", box(0, 0, 2, 2)), ("4", box(1, 1, 3, 3))], f"id string, rings {G.RINGS}")
    assert {r["id"] for r in spatial.uncovered(cells, 2.0).collect()} == {"1", "4"}
    assert spark.createDataFrame([(box(0, 0, 2, 2),)], f"rings {G.RINGS}").select(spatial.scaled(F.col("rings"), 1.5).alias("r")).first()["r"][0][0].asDict() == {"x": -0.5, "y": -0.5}


def test_guards(spark):
    df = spark.createDataFrame([(1, None), (2, "04.00")], "id int, b string")
    with pytest.raises(Exception, match="more than 1"):
        W.at_most(df, 1, "cells").collect()
    with pytest.raises(Exception, match="no footprint of 1"):
        W.required(df, spark.createDataFrame([(2,)], "id int"), "id").collect()
    with pytest.raises(Exception, match="no processing baseline"):
        df.select(N.baseline_offset(F.create_map(F.lit("other"), F.lit("1")))).collect()
    with pytest.raises(Exception, match="no such address"):
        df.select(N.vsi_path(F.lit("http://x/y"))).collect()
    with pytest.raises(ValueError, match="no bands"):
        W.drop_bands(df, ["B99"])
    assert df.where("id = 2").select(N.remaining(F.lit(1), F.lit(4), F.lit(10.0))).first()[0] == "25.0% left 30s"


def test_cube(spark):
    def px(ts, band, dn, crs=32633, offset=0, nodata=0, seq=0, col=0):
        return ("c", 0, col, ts, band, dn, crs, offset, nodata, seq)

    a, b = datetime(2018, 6, 1), datetime(2018, 7, 1)
    rows = [px(a, "B04", 100), px(b, "B04", 110), px(a, "SCL", 8), px(b, "SCL", 4)]  # masked at the first time
    rows += [px(a, "B04", 1200, offset=-1000, col=1), px(a, "B04", 200, seq=1, col=2), px(a, "B04", 400, offset=-1000, col=3)]
    rows += [px(a, "B04", 7, crs=32634, seq=-1, col=4), px(a, "B04", 5, col=4), px(a, "B04", 77, nodata=77, col=5), px(a, "B04", 42, nodata=77, seq=1, col=5)]
    pixels = spark.createDataFrame(rows, "cube string, row int, col int, ts timestamp_ntz, band string, dn int, crs int, offset int, nodata int, seq int")
    out = cube.build(pixels, ["cube"], ["B04"], datetime(2018, 5, 31), datetime(2018, 7, 2), 20)
    got = {(r["col"], r["win"]): r["B04"] for r in out.collect()}
    assert got == {(0, 0): 0, (0, 1): 110, (1, 0): 200, (1, 1): 0, (2, 0): 200, (2, 1): 0, (3, 0): 0, (3, 1): 0, (4, 0): 5, (4, 1): 0, (5, 0): 42, (5, 1): 0}


def test_items(spark):
    tile = ("S2A_N0400_T36NAB_1", "S2", datetime(2018, 6, 1), "/d/1", "B04.tif,SCL.tif", 12.5, -1000, 0, 0.0, 1.0, 2.0, 3.0)
    tiles = spark.createDataFrame([tile], "id string, satellite string, ts timestamp_ntz, folder string, files string, cloud_cover double, offset int, nodata int, xmin double, ymin double, xmax double, ymax double")
    back = stac.rows(stac.items(tiles)).first()
    assert tuple(back) == tuple(v for k, v in enumerate(tile) if k != 3)
    assert '"proj:epsg":32636' in stac.items(tiles).first()["item"]
    assert stac.moved_items(stac.items(tiles), "/d/", "/data/").first()["value"].count('"href":"/data/1/') == 2
    shapes = spark.createDataFrame([("a", '{"type":"Polygon","coordinates":[[[0,0],[1,0],[0,1]]]}'), ("b", '{"type":"Point","coordinates":[0,0]}')], "id string, geometry string")
    assert [r["id"] for r in stac.polygons(shapes).collect()] == ["a"]


def test_rows_with_missing_features(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0, float("nan")])], "id int, x array<double>")
    got = {r["id"]: r["prediction"] for r in model.infer(df, "x", lambda: lambda m: m.sum(1), "sum", -1.0).collect()}
    assert got == {1: 3.0, 2: -1.0, 3: -1.0}

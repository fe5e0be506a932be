"""Hand-computed values for single operators."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cubeframe.functions import bands, geo
from cubeframe.operators import catalog, mosaic, series
from cubeframe.sources.tables import feature_collection
from cubeframe.streaming.mosaic import window_sums


def test_projection(spark):
    df = spark.createDataFrame([(500000.0, 5000000.0, 32633), (500000.0, 5000000.0, 32733)], "e double, n double, epsg int")
    north, south = df.select(*geo.utm_to_lonlat(F.col("e"), F.col("n"), F.col("epsg"))).collect()
    assert north[0] == pytest.approx(15.0) and north[1] == pytest.approx(45.1535, abs=1e-3) and south[1] < 0


def test_bands(spark):
    df = spark.createDataFrame([(1000, 1000, 3000), (0, 5, 0)], "B03 int, B04 int, B08 int")
    row = bands.spectral_indices(df, ["NDVI", "GCVI", "SAVI"]).first()
    assert (row["NDVI"], row["GCVI"]) == (0.5, 2.0) and row["SAVI"] == pytest.approx(2000 * 1.48 / 4000.48)
    with pytest.raises(NotImplementedError):
        bands.spectral_indices(df, ["NOPE"])
    with pytest.raises(ValueError):
        bands.spectral_indices(df, ["NDRE"])
    dn = spark.createDataFrame([(1500,), (500,), (0,)], "dn int").select(bands.with_offset(F.col("dn"), F.lit(-1000))).collect()
    assert [r[0] for r in dn] == [500, 0, 0]


def test_calendar_mosaic(spark):
    rows = [(1, datetime(2018, 1, 2), 10), (1, datetime(2018, 2, 15), 40), (2, datetime(2018, 1, 5), 42), (2, datetime(2018, 1, 6), 77), (2, datetime(2018, 3, 2), None)]
    obs = spark.createDataFrame(rows, "pixel int, ts timestamp_ntz, v int")
    out = mosaic.median_mosaic(obs, ["pixel"], ["v"], datetime(2018, 1, 1), datetime(2018, 3, 2), 20)
    assert sorted(map(tuple, out.collect())) == [(1, 0, 10), (1, 1, 0), (1, 2, 40), (2, 0, 59), (2, 1, 0), (2, 2, 0)]


def test_gaps_and_upsert(spark):
    s = spark.createDataFrame([("a", k, v) for k, v in enumerate([2000, 0, 4000, 0])] + [("b", 0, 0), ("b", 1, 12000)], "p string, t int, v int")
    got = sorted((r["p"], r["t"], r["v"]) for r in series.gap_interpolate(s, ["p"], "t", "v").collect())
    assert [v for *_, v in got] == [2000, 3000, 4000, 4000, 0, 0]
    rows = spark.createDataFrame([("t1", 1, "B02.jp2", 3.0), ("t1", 2, "B08.jp2,SCL.jp2", 12.5)], "id string, seq int, files string, cloud double")
    assert [tuple(r) for r in catalog.upsert(rows, "id", "seq", "files", ["cloud"]).collect()] == [("t1", 12.5, "B02.jp2,B08.jp2,SCL.jp2")]
    with pytest.raises(Exception, match="repeated id"):
        catalog.guard_unique(rows, "id").collect()


def test_features(spark, tmp_path):
    (tmp_path / "a.geojson").write_text('{"features": [{"properties": {"id": "s1"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 1], [2, 1], [2, 5], [0, 1]]]}}]}')
    row = feature_collection(spark, str(tmp_path / "a.geojson")).first()
    assert (row["xmin"], row["ymin"], row["xmax"], row["ymax"]) == (0, 1, 2, 5) and row["properties"]["id"] == "s1"


def test_stream(spark, tmp_path):
    rows = [(1, datetime(2018, 1, 2), 10), (1, datetime(2018, 1, 25), 40), (1, datetime(2018, 6, 1), 0)]
    spark.createDataFrame(rows, "pixel int, ts timestamp, v int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pixel int, ts timestamp, v int").parquet(str(tmp_path / "in"))
    q = window_sums(stream, ["pixel"], "v", datetime(2018, 1, 1), 20).writeStream.format("memory").queryName("sums").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {r["win_start"].date().isoformat(): r["total"] for r in spark.table("sums").collect()}
    assert got["2018-01-01"] == 10 and got["2018-01-21"] == 40


def test_overlapping_by_brute_force(spark):
    import random

    from cubeframe.operators import joins

    r = random.Random(2)
    rows = [(r.choice([None, *range(30)]), r.choice("uv"), lo := r.choice([r.randint(-9, 9), r.uniform(-9, 9)]) * 1.0, lo + r.choice([-2, 0, 1, 2.5, 7])) for _ in range(60)] + [(99, "u", None, 1.0), (98, "v", 1.0, None)]
    df = spark.createDataFrame(rows, "id int, kind string, lo double, hi double")
    whole = [(x, y) for x in rows for y in rows if None not in (*x, *y) and x[0] < y[0] and x[2] < y[3] and y[2] < x[3]]
    for width in (1, 3):
        made = [(tuple(p)[:4], tuple(p)[4:]) for p in joins.overlapping(df, width).collect()]
        assert sorted(made) == sorted(whole)


def test_overlap_query_deals_one_side_only(spark, tmp_path):
    import re
    from datetime import datetime, timedelta

    from cubeframe.plans.queries import QUERIES

    start = datetime(2000, 1, 1)
    rows = [(i, i % 7, start + timedelta(days=i % 60)) for i in range(600)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    iv = [(i, i % 60, i % 60 + 1 + i % 5) for i, _, _ in rows]
    whole = {(a, b) for a, alo, ahi in iv for b, blo, bhi in iv if a < b and alo < bhi and blo < ahi}
    out = QUERIES["interval_overlap_pairs"](spark, str(tmp_path))
    got = out.collect()
    assert len(got) == len(whole) and {(r["a_id"], r["b_id"]) for r in got} == whole
    dealt = re.findall(r"Generate explode", out._jdf.queryExecution().optimizedPlan().toString())
    assert len(dealt) == 1  # one side only is dealt to several buckets


def test_overlapping_shares_a_full_bucket_out(spark):
    from collections import Counter

    from pyspark.sql import functions as F

    from cubeframe.operators import joins

    rows = [(i, 0 if i < 200 else i, 3 + i % 5 if i < 200 else i + 2) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, lo long, hi long")
    whole = sorted((a, b) for a, alo, ahi in rows for b, blo, bhi in rows if a < b and alo < bhi and blo < ahi)
    for most in (10, 4096):
        got = joins.overlapping(df, 1, most).select("a_id", "b_id", F.spark_partition_id()).collect()
        assert sorted(tuple(r)[:2] for r in got) == whole
        if most == 10:  # nearly all pairs are in one bucket
            assert max(Counter(r[2] for r in got).values()) < len(whole) / 2


def test_overlapping_keeps_its_tasks(spark):
    from cubeframe.operators import joins

    df = spark.range(500).selectExpr("id", "id lo", "id + 3 hi")
    out = joins.overlapping(df, 1)
    assert out.count() == 499 + 498 and out.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism

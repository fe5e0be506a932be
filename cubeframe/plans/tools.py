"""Registered queries on work lists, names, reports and items, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from cubeframe.functions import names as N
from cubeframe.operators import cube as Q
from cubeframe.operators import worklists as W
from cubeframe.plans.queries import query
from cubeframe.sources import stac
from cubeframe.sources.tables import table

c, lit = F.col, F.lit
DAY = "date_diff('day', TIMESTAMP '1995-01-01', o_orderdate)"


@query("""SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')
AND c_custkey % 7 <> 0""")
def build_shortfall(spark, d):
    cubes = table(spark, d, "orders").select(c("o_custkey").alias("id"), c("o_orderpriority").alias("window"), (c("o_orderstatus") == "F").alias("complete"))
    shapes = table(spark, d, "customer").select(c("c_custkey").alias("id"))
    return W.build_shortfall(shapes, cubes, shapes.where("id % 7 = 0").withColumn("window", lit("1-URGENT")), lit("1-URGENT"))


@query("""SELECT DISTINCT id, "window" FROM (SELECT o_custkey AS id, o_orderpriority AS "window" FROM orders UNION ALL SELECT c_custkey, '1-URGENT' FROM customer)
WHERE NOT ("window" = '1-URGENT' AND id % 3 = 0)""")
def known_empty_registry(spark, d):
    now = table(spark, d, "orders").select(c("o_custkey").alias("id"), c("o_orderpriority").alias("window"))
    add = table(spark, d, "customer").select(c("c_custkey").alias("id"), lit("1-URGENT").alias("window"))
    return W.known_empty(now, add, add.where("id % 3 = 0"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 3 <> 2")
def manifest_currency(spark, d):
    classes = F.element_at(F.array(lit(""), lit("NaN"), lit("8,9")), (c("o_orderkey") % 3 + 1).cast("int"))
    rows = table(spark, d, "orders").select("o_orderkey", c("o_orderpriority").alias("window"), classes.alias("classes"))
    return W.current(rows, lit("1-URGENT"), lit(None).cast("string")).select("o_orderkey")


@query("""SELECT '/cubes/' || l_orderkey AS folder, count(DISTINCT l_linenumber) FILTER (l_linenumber IN (1, 2) AND l_quantity > 5) = 2 AS present FROM lineitem GROUP BY 1""")
def cube_presence(spark, d):
    x = table(spark, d, "lineitem").select(F.concat(lit("/cubes/"), c("l_orderkey").cast("string")).alias("folder"), "l_linenumber", "l_quantity")
    files = x.select(F.concat("folder", lit("/f"), c("l_linenumber").cast("string")).alias("path"), F.greatest(c("l_quantity") - 5, lit(0)).alias("length"))
    return W.present(x.select("folder").distinct(), files, ["f1", "f2"])


@query("""SELECT 'new/a/' || s_nationkey || '/' || s_suppkey AS path FROM supplier WHERE s_suppkey % 2 = 0""")
def outputs_existing(spark, d):
    s = table(spark, d, "supplier")
    path = lambda root, df: df.select(F.concat_ws("/", lit(root), "s_nationkey", "s_suppkey").alias("path"))
    return W.by_suffix(path("new/a", s), path("old/b/a", s.where("s_suppkey % 2 = 0")))


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def output_footprints(spark, d):
    n = table(spark, d, "nation").select(c("n_nationkey").alias("c_nationkey"), "n_name")
    return W.required(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), n, "c_nationkey").select("c_custkey", "c_name", "n_name")


@query("SELECT n_nationkey, n_name FROM nation")
def limit_guard(spark, d):
    return W.at_most(table(spark, d, "nation"), 25, "cells").select("n_nationkey", "n_name")


@query("SELECT o_orderdate AS ts, max(o_orderkey) AS id FROM orders GROUP BY 1")
def timestamp_ids(spark, d):
    return W.last_ids(table(spark, d, "orders").select(c("o_orderkey").alias("seq"), c("o_orderdate").alias("ts"), c("o_orderkey").alias("id")))


@query("SELECT s_nationkey, s_suppkey AS id, round(s_acctbal, 2) AS coverage FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) = 1")
def best_cell(spark, d):
    out = W.best_cell(table(spark, d, "supplier").select("s_nationkey", c("s_suppkey").alias("id"), c("s_acctbal").alias("coverage")), ["s_nationkey"])
    return out.withColumn("coverage", F.round("coverage", 2))


@query("""WITH x AS (SELECT p_partkey AS id, p_brand AS satellite, 'a.tif' AS files, 0 AS k FROM part UNION ALL SELECT p_partkey, p_name, 'b.tif,c.tif', 1 FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, p_type, 'b.tif', 2 FROM part WHERE p_partkey % 3 = 0)
SELECT id, arg_max(satellite, k) AS satellite, CASE WHEN id % 2 = 0 THEN 'a.tif,b.tif,c.tif' WHEN id % 3 = 0 THEN 'a.tif,b.tif' ELSE 'a.tif' END AS files FROM x GROUP BY id""")
def shard_merge(spark, d):
    p = table(spark, d, "part")
    part = lambda df, col, files: df.select(c("p_partkey").alias("id"), c(col).alias("satellite"), lit(files).alias("files"))
    return W.merge_shards(part(p, "p_brand", "a.tif"), [part(p.where("p_partkey % 2 = 0"), "p_name", "b.tif,c.tif"), part(p.where("p_partkey % 3 = 0"), "p_type", "b.tif")], "id", "files", ["satellite"])


@query("SELECT count(DISTINCT (l_returnflag, l_linestatus)) AS kinds, count(DISTINCT (l_returnflag, l_linestatus)) <= 1 AS consistent FROM lineitem")
def schema_consistency(spark, d):
    return W.schema_consistent(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, o_custkey LIMIT 5")
def duplicate_ids(spark, d):
    return W.duplicate_ids(table(spark, d, "orders"), "o_custkey")


@query("""WITH x AS (SELECT DISTINCT o_custkey, o_orderdate::DATE AS d FROM orders), g AS (SELECT *, date_diff('day', lag(d) OVER (PARTITION BY o_custkey ORDER BY d), d) AS gap FROM x)
SELECT o_custkey, min(d) AS first, max(d) AS last, max(gap)::INT AS max_gap, count(*) AS n, coalesce(max(gap) > 300, false) AS gap_too_long,
date_diff('day', DATE '1995-01-01', min(d)) > 300 AS leading_gap, date_diff('day', max(d), DATE '2000-01-01') > 300 AS trailing_gap FROM g GROUP BY 1""")
def missing_data_check(spark, d):
    x = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("d"))
    return W.coverage(x, ["o_custkey"], "d", 300, lit("1995-01-01").cast("date"), lit("2000-01-01").cast("date"))


@query("""WITH u AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS units FROM orders GROUP BY 1), b AS (SELECT unnest(['1-URGENT', '5-LOW']) AS band),
h AS (SELECT o_custkey, o_orderpriority AS band, count(DISTINCT o_orderkey) AS have FROM orders GROUP BY ALL)
SELECT u.o_custkey, b.band, coalesce(have, 0) AS have, CASE WHEN have IS NULL THEN 'missing' WHEN have < units THEN 'partial' ELSE 'complete' END AS state
FROM u CROSS JOIN b LEFT JOIN h ON h.o_custkey = u.o_custkey AND h.band = b.band""")
def missing_bands(spark, d):
    x = table(spark, d, "orders").withColumnRenamed("o_orderpriority", "band")
    return W.missing_bands(x, ["o_custkey"], "band", "o_orderkey", ["1-URGENT", "5-LOW"])


@query("""WITH r AS (SELECT l_returnflag AS r, count(*) AS n FROM lineitem GROUP BY 1)
SELECT sum(l_quantity)::BIGINT AS qty, bool_or(l_linenumber > 6) AS long, (SELECT string_agg(r || '=' || n, ',' ORDER BY r || '=' || n) FROM r) AS reasons FROM lineitem""")
def download_totals(spark, d):
    x = table(spark, d, "lineitem").select(c("l_quantity").cast("decimal(18,2)").alias("qty"), (c("l_linenumber") > 6).alias("long"), "l_returnflag")
    return W.totals(x, ["qty"], ["long"], "l_returnflag").withColumn("qty", c("qty").cast("long"))


@query("""SELECT event_id, date_diff('second', TIMESTAMP '2024-01-01', ts) AS a_to_b, 60 - date_diff('second', TIMESTAMP '2024-01-01', ts) AS b_to_c, 60::BIGINT AS whole FROM events""")
def timing_legs(spark, d):
    x = table(spark, d, "events").select("event_id", lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("a"), F.date_trunc("second", c("ts")).cast("timestamp_ntz").alias("b"), lit(datetime(2024, 1, 1, 0, 1)).cast("timestamp_ntz").alias("c"))
    return W.legs(x, ["a", "b", "c"]).drop("a", "b", "c")


@query("""WITH f AS (SELECT p_brand AS bundle, p_name || p_partkey AS path, p_type AS content FROM part)
SELECT bundle, sha256(unhex(string_agg(hex(path) || '00' || hex(content), '' ORDER BY path))) AS digest FROM f GROUP BY 1""")
def content_digest(spark, d):
    x = table(spark, d, "part").select(c("p_brand").alias("bundle"), F.concat("p_name", c("p_partkey").cast("string")).alias("path"), F.encode("p_type", "UTF-8").alias("content"))
    return W.digest(x)


@query("""SELECT p_type, count(*) AS n, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS members FROM part GROUP BY 1""")
def provenance_counts(spark, d):
    return W.provenance(table(spark, d, "part"), "p_type", "p_brand")


@query("""WITH a AS (SELECT p_partkey AS id, unnest(['B02_20m', 'B02_10m', 'SCL_20m', 'B08_60m']) AS key FROM part)
SELECT id, split_part(key, '_', 1) AS band, min(key) AS key, id || '/' || min(key) AS href FROM a WHERE split_part(key, '_', 1) IN ('B02', 'B08', 'B99') GROUP BY id, band""")
def choose_assets(spark, d):
    keys = F.array(*map(lit, ("B02_20m", "B02_10m", "SCL_20m", "B08_60m")))
    x = table(spark, d, "part").select(c("p_partkey").alias("id"), F.map_from_arrays(keys, F.transform(keys, lambda k: F.concat_ws("/", "p_partkey", k))).alias("assets"))
    return W.choose_assets(x, ["B02", "B08", "B99"])


@query("SELECT s_suppkey, NOT (s_nationkey = 3 AND s_suppkey % 2 = 0) AS resample FROM supplier")
def resample_needed(spark, d):
    x = table(spark, d, "supplier").select("s_suppkey", c("s_nationkey").alias("crs"), (c("s_suppkey") % 2).alias("height"), lit(5).alias("width"))
    ref = spark.range(1).select(lit(3).cast(x.schema["crs"].dataType).alias("crs"), lit(0).cast(x.schema["height"].dataType).alias("height"), lit(5).alias("width"))
    return W.needs_resample(x, ref).select("s_suppkey", "resample")


@query("""WITH r AS (SELECT o_totalprice::DECIMAL(18,2) AS length, count(*) OVER (PARTITION BY o_orderdate::DATE) AS peak FROM orders)
SELECT peak, count(*) AS n, round(avg(length), 4) AS mean, round(median(length::DOUBLE), 4) AS median FROM r GROUP BY 1""")
def duration_by_concurrency(spark, d):
    x = table(spark, d, "orders").select("o_orderdate", lit(0).cast("decimal(18,2)").alias("lo"), c("o_totalprice").cast("decimal(18,2)").alias("hi"))
    out = W.concurrency(x.withColumn("day", F.to_date("o_orderdate")), "lo", "hi", c("day"))
    return out.select("peak", "n", F.round(c("mean").cast("double"), 4).alias("mean"), F.round(c("median").cast("double"), 4).alias("median"))


@query("SELECT min(o_orderdate) AS actual_start, max(o_orderdate) AS actual_end, o_custkey FROM orders GROUP BY o_custkey")
def acquisition_range(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("actual_start"), F.max("o_orderdate").alias("actual_end"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN -1000 WHEN s_suppkey % 3 = 1 THEN CASE WHEN s_suppkey % 2 = 0 THEN -1000 ELSE 0 END END AS "offset",
CASE s_suppkey % 3 WHEN 0 THEN 'declared' WHEN 1 THEN 'derived' ELSE 'missing' END AS source FROM supplier""")
def offset_provenance(spark, d):
    k = c("s_suppkey")
    item = F.when(k % 3 == 1, F.when(k % 2 == 0, "S2A_N0400_R1").otherwise("S2A_N0301_R1")).otherwise("S2A")
    found = N.offset_and_source(F.when(k % 3 == 0, lit(-1000)), item)
    return table(spark, d, "supplier").select("s_suppkey", found.alias("f")).select("s_suppkey", "f.*")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN -1000 ELSE 0 END AS \"offset\" FROM supplier")
def baseline_offset(spark, d):
    even = c("s_suppkey") % 2 == 0
    name, value = F.when(even, "processing:version").otherwise("s2:processing_baseline"), F.when(even, "05.09").otherwise("02.14")
    return table(spark, d, "supplier").select("s_suppkey", N.baseline_offset(F.create_map(name, value)).alias("offset"))


@query("""SELECT p_partkey, 'data/' || p_partkey || '/x.jp2' AS path, p_partkey::VARCHAR AS parent, '/vsiaz/c/' || p_partkey AS vsi, 'new/' || p_partkey || '.tif,keep.tif' AS moved,
CASE p_partkey % 3 WHEN 0 THEN 'SlowDown' WHEN 1 THEN 'NoSuchKey' ELSE 'Other' END AS reason, CASE WHEN p_partkey % 2 = 0 THEN 'image/jp2' ELSE 'application/xml' END AS media,
repeat('n', 6) || '.tif' AS short FROM part""")
def path_rules(spark, d):
    k = c("p_partkey").cast("string")
    path, parent = N.source_path(F.concat(lit("s3://bucket/data/"), k, lit(".SAFE/x.jp2")))
    message = F.element_at(F.array(lit("err SlowDown x"), lit("NoSuchKey"), lit("?")), (c("p_partkey") % 3 + 1).cast("int"))
    return table(spark, d, "part").select(
        "p_partkey", path.alias("path"), parent.alias("parent"), N.vsi_path(F.concat(lit("abfss://c@acct.dfs.net/"), k)).alias("vsi"),
        N.moved(F.concat(lit("old/"), k, lit(".jp2,keep.tif")), "old/", "new/").alias("moved"), N.error_label(message, ["SlowDown", "NoSuchKey"], lit("Other")).alias("reason"),
        N.media_type(F.when(c("p_partkey") % 2 == 0, "a.JP2").otherwise("MTD.xml")).alias("media"), N.shortened(F.concat(F.repeat(lit("n"), 30), lit(".tif")), 10).alias("short"),
    )


@query("""SELECT c_custkey, (c_custkey % least((SELECT count(*) FROM customer), 16))::BIGINT AS shard, CASE WHEN c_acctbal + 100 > 0 THEN round((100 - c_acctbal) / (c_acctbal + 100), 6) END AS ndvi,
round(greatest(c_acctbal * 1024 / 10, 1800), 4) AS timeout FROM customer""")
def small_rules(spark, d):
    x = table(spark, d, "customer")
    n = x.agg(F.count(lit(1)).alias("n"))
    b = c("c_acctbal")
    return x.crossJoin(F.broadcast(n)).select("c_custkey", N.shard(c("c_custkey"), c("n"), 16).cast("long").alias("shard"), F.round(N.guarded_ndvi(b, lit(100.0)), 6).alias("ndvi"), F.round(N.timeout_seconds(b), 4).alias("timeout"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE (o_orderdate::DATE)::TIMESTAMP END AS ts FROM orders""")
def utc_coercion(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.element_at(F.array(F.concat(day, lit("T00:00:00")), F.concat(day, lit("T01:00:00+01:00")), lit("no time")), (c("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", N.utc(text).cast("timestamp_ntz").alias("ts"))


_TILES = """SELECT 'S2A_T' || lpad((1 + p_partkey % 60)::VARCHAR, 2, '0') || 'QPB_' || p_partkey AS id, p_brand AS satellite, TIMESTAMP '2018-01-01' + INTERVAL (p_partkey) HOUR AS ts, 'B02.tif,B08.tif,SCL.tif' AS files,
p_size::DOUBLE AS cloud_cover, CASE WHEN p_partkey % 2 = 0 THEN -1000 ELSE 0 END AS "offset", 0 AS nodata, (p_partkey % 50)::DOUBLE AS xmin, (p_partkey % 40)::DOUBLE AS ymin, (p_partkey % 50 + 1)::DOUBLE AS xmax, (p_partkey % 40 + 1)::DOUBLE AS ymax FROM part"""


def _tiles(spark, d):
    k = c("p_partkey")
    name = F.concat(lit("S2A_T"), F.lpad((1 + k % 60).cast("string"), 2, "0"), lit("QPB_"), k.cast("string"))
    ts = F.timestamp_add("HOUR", k.cast("int"), lit(datetime(2018, 1, 1)).cast("timestamp_ntz"))
    return table(spark, d, "part").select(
        name.alias("id"), c("p_brand").alias("satellite"), ts.alias("ts"), F.concat(lit("/data/"), k.cast("string")).alias("folder"), lit("SCL.tif,B08.tif,B02.tif").alias("files"), c("p_size").cast("double").alias("cloud_cover"),
        F.when(k % 2 == 0, -1000).otherwise(0).alias("offset"), lit(0).alias("nodata"), *[(a + b).cast("double").alias(n) for a, b, n in ((k % 50, 0, "xmin"), (k % 40, 0, "ymin"), (k % 50, 1, "xmax"), (k % 40, 1, "ymax"))],
    )


@query(_TILES)
def stac_round_trip(spark, d):
    return stac.rows(stac.items(_tiles(spark, d)))


@query(f"""WITH t AS ({_TILES}) SELECT id, unnest(['B02', 'SCL']) AS band, '/data/' || split_part(id, '_', 3) || '/' || unnest(['B02', 'SCL']) || '.tif' AS href,
'POLYGON ((' || xmin || ' ' || ymin || ', ' || xmax || ' ' || ymin || ', ' || xmax || ' ' || ymax || ', ' || xmin || ' ' || ymax || ', ' || xmin || ' ' || ymin || '))' AS wkt FROM t""")
def stac_asset_rows(spark, d):
    return stac.asset_rows(stac.items(_tiles(spark, d)), ["B02", "SCL", "B99"])


@query(f"""WITH t AS ({_TILES}) SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax, min(ts) AS "start", max(ts) AS "end" FROM t""")
def stac_extent(spark, d):
    return stac.extent(_tiles(spark, d))


@query("""WITH p AS (SELECT user_id % 40 AS cube, user_id AS col, date_trunc('day', ts) AS ts, event_id AS seq, CASE event_type WHEN 'view' THEN 'B04' WHEN 'purchase' THEN 'B04' WHEN 'click' THEN 'B08' WHEN 'error' THEN 'B08' ELSE 'SCL' END AS band,
  32630 + (event_id % 3 = 0)::INT AS crs, CASE WHEN event_id % 2 = 0 THEN -1000 ELSE 0 END AS off, CASE event_type WHEN 'signup' THEN (props->>'$.k')::INT % 12 ELSE floor(value * 100)::INT END AS raw FROM events),
m AS (SELECT cube, arg_max(crs, row(n, crs)) AS ref FROM (SELECT cube, crs, count(*) AS n FROM p GROUP BY ALL) GROUP BY 1),
v AS (SELECT p.*, crs <> ref AS "foreign", CASE WHEN raw <> 0 THEN CASE WHEN band LIKE 'B%' THEN least(greatest(raw + off, 0), 65535) ELSE raw END END AS dn FROM p JOIN m USING (cube)),
f AS (SELECT cube, col, ts, band, arg_min(dn, row("foreign", seq)) FILTER (dn IS NOT NULL) AS dn FROM v GROUP BY ALL),
w AS (SELECT cube, col, ts, max(dn) FILTER (band = 'B04') AS b4, max(dn) FILTER (band = 'B08') AS b8, max(dn) FILTER (band = 'SCL') AS scl FROM f GROUP BY ALL),
k AS (SELECT cube, col, ts, CASE WHEN coalesce(scl NOT IN (0, 1, 3, 7, 8, 9, 10), true) THEN b4 END AS b4, CASE WHEN coalesce(scl NOT IN (0, 1, 3, 7, 8, 9, 10), true) THEN b8 END AS b8 FROM w),
x AS (SELECT *, least(floor(date_diff('second', TIMESTAMP '2024-01-01', ts) / 604800.0)::INT, 4) AS win FROM k WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31'),
s AS (SELECT cube, col, unnest(range(0, 5))::INT AS win FROM (SELECT DISTINCT cube, col FROM k))
SELECT s.cube, 0 AS row, s.col, s.win, coalesce(trunc(median(b4))::INT, 0) AS B04, coalesce(trunc(median(b8))::INT, 0) AS B08 FROM s LEFT JOIN x USING (cube, col, win) GROUP BY ALL""")
def cube_build(spark, d):
    e = table(spark, d, "events")
    kind = c("event_type")
    band = F.when(kind.isin("view", "purchase"), "B04").when(kind.isin("click", "error"), "B08").otherwise("SCL")
    dn = F.when(kind == "signup", F.get_json_object("props", "$.k").cast("int") % 12).otherwise(F.floor(c("value") * 100).cast("int"))
    x = e.select(
        (c("user_id") % 40).alias("cube"), lit(0).alias("row"), c("user_id").alias("col"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), band.alias("band"), dn.alias("dn"),
        (32630 + (c("event_id") % 3 == 0).cast("int")).alias("crs"), F.when(c("event_id") % 2 == 0, -1000).otherwise(0).alias("offset"), lit(0).alias("nodata"), c("event_id").alias("seq"),
    )
    return Q.build(x, ["cube"], ["B04", "B08"], datetime(2024, 1, 1), datetime(2024, 1, 31), 7)

"""The registered queries of the engine, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from datetime import datetime

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from cubeframe.functions import bands as B
from cubeframe.functions import geo
from cubeframe.operators import catalog as C
from cubeframe.operators import joins as J
from cubeframe.operators import model as M
from cubeframe.operators import mosaic as Z
from cubeframe.operators import series as S
from cubeframe.sources.tables import observations, table

START, END, DAYS = datetime(2024, 1, 1), datetime(2024, 1, 31), 7
T = 5
OBS = """obs AS (SELECT user_id AS pixel, CASE event_type WHEN 'view' THEN 'B02' WHEN 'purchase' THEN 'B03' WHEN 'click' THEN 'B04'
  WHEN 'error' THEN 'B08' WHEN 'signup' THEN 'B11' END AS band, ts, nullif(floor(value * 100)::INT, 0) AS dn,
  (props->>'$.k')::INT % 12 AS scl, event_id AS seq FROM events),
win AS (SELECT *, least(floor(date_diff('second', TIMESTAMP '2024-01-01', ts) / 604800.0)::INT, 4) AS win FROM obs
  WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31'),
spine AS (SELECT pixel, unnest(range(0, 5))::INT AS win FROM (SELECT DISTINCT pixel FROM obs))"""
CLEAR = "dn IS NOT NULL AND scl NOT IN (0, 1, 3, 7, 8, 9, 10)"
ALL = ["B02", "B03", "B04", "B08", "B11"]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _med(b: str, cond: str = "dn IS NOT NULL") -> str:
    return f"coalesce(trunc(median(dn) FILTER (band = '{b}' AND {cond}))::INT, 0) AS {b}"


@query(f"WITH {OBS} SELECT s.pixel, s.win, {', '.join(_med(b) for b in ALL)} FROM spine s LEFT JOIN win w USING (pixel, win) GROUP BY ALL")
def calendar_median_mosaic(spark, d):
    return Z.median_mosaic(Z.wide(observations(spark, d), ALL, F.col("dn")), ["pixel"], ALL, START, END, DAYS)


@query(f"""WITH {OBS}, m AS (SELECT s.pixel, s.win, {_med('B04', CLEAR)}, {_med('B08', CLEAR)} FROM spine s LEFT JOIN win w USING (pixel, win) GROUP BY ALL)
SELECT *, round((B08 - B04)::DOUBLE / nullif(B08 + B04, 0), 6) AS ndvi FROM m""")
def masked_mosaic_ndvi(spark, d):
    return Z.pixel_indices(spark, observations(spark, d), START, END, DAYS)


_N = "nullif({}, 0)"


@query(f"""WITH {OBS}, m AS (SELECT s.pixel, s.win, {', '.join(_med(b) for b in ALL)} FROM spine s LEFT JOIN win w USING (pixel, win) GROUP BY ALL),
x AS (SELECT pixel, win, B02::DOUBLE b2, B03::DOUBLE b3, B04::DOUBLE b4, B08::DOUBLE b8, B11::DOUBLE b11, b3 AS b5, b2 AS b6, b4 AS b12 FROM m)
SELECT pixel, win, round((b8-b4)/nullif(b8+b4,0),6) AS "NDVI", round((b3-b8)/nullif(b3+b8,0),6) AS "NDWI_green", round((b2-b8)/nullif(b2+b8,0),6) AS "NDWI_blue",
round((b8-b11)/nullif(b8+b11,0),6) AS "LSWI_B11", round(b8/nullif(b3,0)-1,6) AS "GCVI", round((b8-b4)*1.48/nullif(b8+b4+0.48,0),6) AS "SAVI",
round(((b11+b4)-(b8+b2))/nullif((b11+b4)+(b8+b2),0),6) AS "BSI", round((b8-b5)/nullif(b8+b5,0),6) AS "NDRE", round((b8-b12)/nullif(b8+b12,0),6) AS "LSWI_B12",
round((b4-b2)/nullif(b6,0),6) AS "PSRI", round((b11-b12)/nullif(b11+b12,0),6) AS "NDTI_tillage" FROM x""")
def spectral_indices(spark, d):
    names = list(B.INDICES)
    stand_ins = {"B05": F.col("B03"), "B06": F.col("B02"), "B12": F.col("B04")}
    out = B.spectral_indices(calendar_median_mosaic(spark, d).withColumns(stand_ins), names)
    return out.select("pixel", "win", *[F.round(n, 6).alias(n) for n in names])


@query(f"""WITH RECURSIVE {OBS}, t AS (SELECT pixel, ts, row_number() OVER (PARTITION BY pixel ORDER BY ts) AS i, date_diff('second', TIMESTAMP '2024-01-01', ts) AS s FROM (SELECT DISTINCT pixel, ts FROM obs)),
a AS (SELECT pixel, ts, i, 0 AS w, CASE WHEN s > 604800 THEN 1209600 ELSE 604800 END AS e FROM t WHERE i = 1
UNION ALL SELECT t.pixel, t.ts, t.i, a.w + (t.s > a.e)::INT, a.e + 604800 * (t.s > a.e)::INT FROM a JOIN t ON t.pixel = a.pixel AND t.i = a.i + 1)
SELECT a.pixel, a.w AS win, band, trunc(median(dn))::INT AS dn FROM a JOIN obs ON obs.pixel = a.pixel AND obs.ts = a.ts GROUP BY ALL""")
def acquisition_mosaic(spark, d):
    obs = observations(spark, d)
    wins = Z.acquisition_windows(obs.select("pixel", "ts").distinct(), "pixel", START, DAYS)
    return obs.join(wins, ["pixel", "ts"]).groupBy("pixel", "win", "band").agg(F.median("dn").cast("int").alias("dn"))


@query(f"WITH {OBS} SELECT win, band, trunc(median(dn))::INT AS dn FROM win WHERE dn IS NOT NULL GROUP BY ALL")
def area_median(spark, d):
    obs = observations(spark, d).where("dn IS NOT NULL").where(Z.within(F.col("ts"), START, END))
    return obs.groupBy(Z.window_index(F.col("ts"), START, END, DAYS).alias("win"), "band").agg(F.median("dn").cast("int").alias("dn"))


@query("""SELECT label, i::INT AS t, round(median(v), 6) AS value FROM (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY ALL""")
def median_per_id(spark, d):
    x = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("t", "v"))
    return x.groupBy("label", "t").agg(F.round(F.median(F.col("v").cast("double")), 6).alias("value"))


@query(f"""WITH {OBS}, b AS (SELECT pixel, seq, ts, dn, row_number() OVER w AS i, CASE WHEN dn > 100 AND dn < 20000 THEN dn END AS g FROM obs WHERE band = 'B08' WINDOW w AS (PARTITION BY pixel ORDER BY ts)),
p AS (SELECT *, last_value(g IGNORE NULLS) OVER a AS pv, last_value(CASE WHEN g IS NOT NULL THEN i END IGNORE NULLS) OVER a AS pi,
first_value(g IGNORE NULLS) OVER z AS nv, first_value(CASE WHEN g IS NOT NULL THEN i END IGNORE NULLS) OVER z AS ni FROM b
WINDOW a AS (PARTITION BY pixel ORDER BY ts ROWS UNBOUNDED PRECEDING), z AS (PARTITION BY pixel ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT pixel, seq, floor(coalesce(g, CASE WHEN ni > pi THEN pv + (nv - pv) * (i - pi)::DOUBLE / (ni - pi) END, pv, nv, 0))::INT AS dn FROM p""")
def gap_interpolate(spark, d):
    b = observations(spark, d).where("band = 'B08'").select("pixel", "seq", "ts", "dn")
    return S.gap_interpolate(b, ["pixel"], "ts", "dn", 100, 20000).select("pixel", "seq", "dn")


@query(f"WITH {OBS} SELECT seq, least(greatest(coalesce(dn, 0) - CASE WHEN band = 'B02' THEN 0 ELSE 1000 END, 0), 65535)::INT AS dn FROM obs")
def offset_harmonize(spark, d):
    off = F.when(F.col("band") == "B02", 0).otherwise(-1000)
    return observations(spark, d).select("seq", B.with_offset(F.coalesce("dn", F.lit(0)), off).alias("dn"))


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - 25) / 10, 6) AS l_quantity, round((l_extendedprice - 25) / 10, 6) AS l_extendedprice FROM lineitem")
def scale_bands(spark, d):
    x = B.scaled(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], 25, 10)
    return x.select("l_orderkey", "l_linenumber", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_extendedprice", 6).alias("l_extendedprice"))


@query("SELECT * EXCLUDE (o_orderdate, o_totalprice, o_orderpriority, o_orderstatus) FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'")
def date_range_filter(spark, d):
    x = table(spark, d, "orders").where(Z.within(F.col("o_orderdate"), datetime(1996, 1, 1), datetime(1996, 12, 31)))
    return x.drop("o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus")


@query("""SELECT user_id, arg_max(event_type, event_id) AS satellite, arg_max(round(value, 2), event_id) AS cloud_cover, string_agg(DISTINCT event_type || '.tif', ',' ORDER BY event_type || '.tif') AS files FROM events GROUP BY user_id""")
def catalog_upsert(spark, d):
    x = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("satellite"), F.round("value", 2).alias("cloud_cover"), F.concat("event_type", F.lit(".tif")).alias("files"))
    return C.upsert(x, "user_id", "event_id", "files", ["satellite", "cloud_cover"])


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_shipdate DESC, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) = 1")
def dedupe_reprocessed(spark, d):
    order = [F.col("l_shipdate"), *[-F.col(c) for c in ("l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")]]
    return C.latest(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"], order).select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey")


@query("SELECT o_custkey, o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) = 1")
def work_unit_dedupe(spark, d):
    return C.latest(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], [F.col("o_orderdate"), -F.col("o_orderkey")]).select("o_custkey", "o_orderpriority", "o_orderkey")


@query("""WITH x AS (SELECT p_partkey, unnest(string_split(replace(p_name, ' ', '.jp2,') || '.tif,MTD_TL.xml', ',')) AS file FROM part)
SELECT p_partkey, file, regexp_extract(file, '([^/]*?)\\.[^./]*$', 1) AS band FROM x WHERE NOT file LIKE '%.xml'""")
def band_explode(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.concat(F.regexp_replace("p_name", " ", ".jp2,"), F.lit(".tif,MTD_TL.xml")).alias("files"))
    return C.explode_files(x, "files").select("p_partkey", "file", "band")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def download_shortfall(spark, d):
    return C.shortfall(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_existing(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT count(*) AS needed, count(l) AS present, count(*) - count(l) AS missing FROM (SELECT DISTINCT p_partkey FROM part) LEFT JOIN (SELECT DISTINCT l_partkey AS l FROM lineitem WHERE l_quantity > 49) ON l = p_partkey")
def plan_needed_present_missing(spark, d):
    return C.plan_counts(table(spark, d, "part"), table(spark, d, "lineitem").where("l_quantity > 49").withColumnRenamed("l_partkey", "p_partkey"), "p_partkey")


@query("""WITH a AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0), b AS (SELECT c_custkey FROM customer WHERE c_nationkey < 12)
SELECT c_custkey, 'only_left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT c_custkey, 'only_right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def resume_identity_diff(spark, d):
    c = table(spark, d, "customer")
    return C.difference(c.where("c_acctbal > 0"), c.where("c_nationkey < 12"), "c_custkey")


@query("""SELECT o_orderkey, coalesce(n, 0) AS done, CASE WHEN n IS NULL THEN 'missing' WHEN n < 3 THEN 'failed' ELSE 'ok' END AS status
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def job_status_left(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") < 3, "failed").otherwise("ok")
    return table(spark, d, "orders").join(n, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("done"), status.alias("status"))


@query("SELECT floor(date_diff('day', TIMESTAMP '1995-01-01', l_shipdate) / 90.0)::INT AS win, count(*) AS n, sum(l_quantity)::BIGINT AS qty FROM lineitem GROUP BY 1")
def calendar_bins(spark, d):
    win = F.floor(F.date_diff("l_shipdate", F.lit("1995-01-01").cast("date")) / 90).cast("int")
    return table(spark, d, "lineitem").groupBy(win.alias("win")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("qty"))


_IV = "SELECT o_orderkey AS id, o_custkey AS tile, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS lo, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) + 1 + o_orderkey % 5 AS hi FROM orders"


@query(f"""WITH i AS ({_IV}) SELECT a.id AS a_id, b.id AS b_id, CASE WHEN a.tile = b.tile THEN 'same-tile' ELSE 'diff-tile' END AS kind
FROM i a JOIN i b ON a.id < b.id AND a.lo < b.hi AND b.lo < a.hi""")
def interval_overlap_pairs(spark, d):
    day = F.date_diff("o_orderdate", F.lit("1995-01-01").cast("date"))
    i = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("tile"), day.alias("lo"), (day + 1 + F.col("o_orderkey") % 5).alias("hi"))
    kind = F.when(F.col("a_tile") == F.col("b_tile"), "same-tile").otherwise("diff-tile")
    return J.overlapping(i, 1).select("a_id", "b_id", kind.alias("kind"))


@query("""WITH m AS (SELECT o_orderdate::DATE AS moment, 1 AS d FROM orders UNION ALL SELECT o_orderdate::DATE + (1 + o_orderkey % 5)::INT, -1 FROM orders)
SELECT moment, (sum(sum(d)) OVER (ORDER BY moment))::BIGINT AS running FROM m GROUP BY moment""")
def in_flight_count(spark, d):
    x = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("lo"), F.date_add(F.to_date("o_orderdate"), (1 + F.col("o_orderkey") % 5).cast("int")).alias("hi"))
    return S.in_flight(x, "lo", "hi").withColumnRenamed("at", "moment")


_BX = """a AS (SELECT p_partkey AS a_id, (p_partkey * 37 % 360 - 180)::DOUBLE AS x, (p_partkey * 53 % 170 - 85)::DOUBLE AS y, 1 + p_size % 4 AS s FROM part),
b AS (SELECT s_suppkey AS b_id, (s_suppkey * 91 % 360 - 180)::DOUBLE AS x, (s_suppkey * 29 % 170 - 85)::DOUBLE AS y, 3 + s_nationkey % 5 AS s FROM supplier)"""


def _boxes(spark, d):
    box = lambda df, p, i, kx, ky, s: df.select(F.col(i).alias(f"{p}_id"), (F.col(i) * kx % 360 - 180).cast("double").alias(f"{p}_xmin"), (F.col(i) * ky % 170 - 85).cast("double").alias(f"{p}_ymin"), s.alias("s")).select(f"{p}_id", f"{p}_xmin", f"{p}_ymin", (F.col(f"{p}_xmin") + F.col("s")).alias(f"{p}_xmax"), (F.col(f"{p}_ymin") + F.col("s")).alias(f"{p}_ymax"))
    a = box(table(spark, d, "part"), "a", "p_partkey", 37, 53, 1 + F.col("p_size") % 4)
    return J.box_pairs(a, box(table(spark, d, "supplier"), "b", "s_suppkey", 91, 29, 3 + F.col("s_nationkey") % 5), 8.0)


@query(f"WITH {_BX} SELECT a_id, b_id FROM a JOIN b ON a.x <= b.x + b.s AND b.x <= a.x + a.s AND a.y <= b.y + b.s AND b.y <= a.y + a.s")
def spatial_bbox_join(spark, d):
    return _boxes(spark, d).select("a_id", "b_id")


@query(f"""WITH {_BX} SELECT a_id, b_id, round(100.0 * greatest(0, least(a.x + a.s, b.x + b.s) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.s, b.y + b.s) - greatest(a.y, b.y)) / (b.s * b.s), 4) AS area_contribution
FROM a JOIN b ON a.x <= b.x + b.s AND b.x <= a.x + a.s AND a.y <= b.y + b.s AND b.y <= a.y + a.s""")
def area_contribution(spark, d):
    c = F.col
    area = geo.overlap(c("a_xmin"), c("a_xmax"), c("b_xmin"), c("b_xmax")) * geo.overlap(c("a_ymin"), c("a_ymax"), c("b_ymin"), c("b_ymax"))
    return _boxes(spark, d).select("a_id", "b_id", F.round(100.0 * area / ((c("b_xmax") - c("b_xmin")) * (c("b_ymax") - c("b_ymin"))), 4).alias("area_contribution"))


def _dominant(spark, d, how):
    by = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "s_nationkey").agg(how.alias("m"))
    return by.groupBy("n_regionkey").agg(F.max_by("s_nationkey", F.struct("m", "s_nationkey")).alias("crs"))


@query("SELECT n_regionkey, s_nationkey AS crs FROM (SELECT n_regionkey, s_nationkey, avg(s_acctbal::DECIMAL(18,2)) AS m FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY m DESC, s_nationkey DESC) = 1")
def dominant_crs_mean(spark, d):
    return _dominant(spark, d, F.avg(F.col("s_acctbal").cast("decimal(18,2)")))


@query("SELECT n_regionkey, s_nationkey AS crs FROM (SELECT n_regionkey, s_nationkey, sum(s_acctbal::DECIMAL(18,2)) AS m FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY m DESC, s_nationkey DESC) = 1")
def dominant_crs_sum(spark, d):
    return _dominant(spark, d, F.sum(F.col("s_acctbal").cast("decimal(18,2)")))


@query("""WITH g AS (SELECT o_custkey, date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate) AS gap FROM orders)
SELECT o_custkey, max(gap)::INT AS max_gap, count(*) AS n, coalesce(max(gap) > 365, false) AS too_long FROM g GROUP BY 1""")
def coverage_gaps(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    g = table(spark, d, "orders").withColumn("gap", F.date_diff("o_orderdate", F.lag("o_orderdate").over(w)))
    return g.groupBy("o_custkey").agg(F.max("gap").alias("max_gap"), F.count(F.lit(1)).alias("n"), F.coalesce(F.max("gap") > 365, F.lit(False)).alias("too_long"))


@query(f"WITH {OBS} SELECT pixel, band, arg_min(dn, row(scl > 5, seq)) FILTER (dn > 500) AS dn FROM obs GROUP BY ALL")
def first_valid_merge(spark, d):
    return S.first_valid(observations(spark, d).withColumn("dn", F.when(F.col("dn") > 500, F.col("dn"))), ["pixel", "band"], "dn", [F.col("scl") > 5, F.col("seq")])


@query(f"""WITH {OBS}, m AS (SELECT s.pixel, s.win, {_med('B04', CLEAR)}, {_med('B08', CLEAR)} FROM spine s LEFT JOIN win w USING (pixel, win) GROUP BY ALL)
SELECT pixel, array_to_string(flatten(list([B04, B08] ORDER BY win)), ',') AS features FROM m GROUP BY pixel HAVING bool_or(B04 <> 0 OR B08 <> 0)""")
def flatten_pixels(spark, d):
    out = S.flatten(masked_mosaic_ndvi(spark, d), ["pixel"], "win", ["B04", "B08"])
    return out.select("pixel", F.array_join(F.col("features").cast("array<string>"), ",").alias("features"))


@query("SELECT vec_id, CASE WHEN list_sum(embedding[1:32]) > list_sum(embedding[33:64]) THEN 1 ELSE 0 END::DOUBLE AS prediction FROM embeddings")
def linear_infer(spark, d):
    def load():
        w = np.repeat([1.0, -1.0], 32)
        return lambda x: (x.astype(float) @ w[: x.shape[1]] > 0).astype(float)

    return M.infer(table(spark, d, "embeddings"), "embedding", load, "halves", -1.0).select("vec_id", "prediction")


@query(f"""WITH {OBS}, x AS (SELECT c_mktsegment AS label, win, band, dn FROM win JOIN customer ON c_custkey = pixel WHERE dn IS NOT NULL)
SELECT label, win, band, median(dn)::DOUBLE AS median_dn, round(avg(dn), 6) AS mean_dn, count(*) AS n FROM x GROUP BY ALL""")
def class_phenology(spark, d):
    obs = observations(spark, d).where("dn IS NOT NULL").where(Z.within(F.col("ts"), START, END)).withColumn("win", Z.window_index(F.col("ts"), START, END, DAYS))
    x = obs.join(table(spark, d, "customer"), F.col("pixel") == F.col("c_custkey"))
    return x.groupBy(F.col("c_mktsegment").alias("label"), "win", "band").agg(F.median("dn").alias("median_dn"), F.round(F.avg("dn"), 6).alias("mean_dn"), F.count(F.lit(1)).alias("n"))


_MJ = "SELECT lower(trim(p_type)) AS crop, sum(l_quantity)::BIGINT AS area FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"


@query(f"""WITH a AS ({_MJ}), t AS (SELECT crop FROM a ORDER BY area DESC, crop LIMIT 2)
SELECT CASE WHEN crop IN (SELECT crop FROM t) THEN crop ELSE 'other' END AS label, sum(area)::BIGINT AS area FROM a GROUP BY 1""")
def major_classes_topk(spark, d):
    a = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.lower(F.trim("p_type")).alias("crop")).agg(F.sum("l_quantity").cast("long").alias("area"))
    top = a.orderBy(F.desc("area"), "crop").limit(2).select("crop", F.col("crop").alias("major"))
    return a.join(top, "crop", "left").groupBy(F.coalesce("major", F.lit("other")).alias("label")).agg(F.sum("area").alias("area"))


@query("""WITH c AS (SELECT c_nationkey AS cell, c_mktsegment AS label, count(*) AS n FROM customer GROUP BY ALL)
SELECT cell, sum(n)::BIGINT AS fields, count(*) AS labels, round(max(n) / sum(n), 6) AS top_share, dense_rank() OVER (ORDER BY sum(n) DESC)::INT AS rank FROM c GROUP BY cell""")
def cell_survey(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("cell"), "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    x = c.groupBy("cell").agg(F.sum("n").alias("fields"), F.count(F.lit(1)).alias("labels"), F.round(F.max("n") / F.sum("n"), 6).alias("top_share"))
    return x.withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("fields"))))  # one row for each cell


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS tiles, count(DISTINCT l_orderkey) AS cells FROM lineitem GROUP BY 1")
def tile_sharing(spark, d):
    x = table(spark, d, "lineitem")
    one = lambda c, name: x.select("l_suppkey", c).distinct().groupBy("l_suppkey").agg(F.count(c).alias(name))  # noqa: E731  distinct pairs first: no key in one task
    return one("l_partkey", "tiles").join(one("l_orderkey", "cells"), "l_suppkey")


_YR = "SELECT year(o_orderdate)::INT AS cores, sum(o_totalprice::DECIMAL(18,2)) AS total FROM orders GROUP BY 1"


@query(f"WITH y AS ({_YR}) SELECT cores, round((first_value(total) OVER (ORDER BY cores))::DOUBLE / total::DOUBLE, 6) AS speedup FROM y")
def sweep_speedup(spark, d):
    y = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("cores")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    first = F.first("total").over(Window.orderBy("cores").rowsBetween(Window.unboundedPreceding, 0))
    return y.select("cores", F.round(first.cast("double") / F.col("total").cast("double"), 6).alias("speedup"))


@query(f"WITH y AS ({_YR}), n AS (SELECT cores, total, lead(total) OVER (ORDER BY cores) AS nxt FROM y) SELECT min(cores) AS knee FROM n WHERE nxt > total * 0.95")
def knee(spark, d):
    y = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("cores")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    return y.withColumn("nxt", F.lead("total").over(Window.orderBy("cores"))).where(F.col("nxt") > F.col("total") * F.lit("0.95").cast("decimal(3,2)")).agg(F.min("cores").alias("knee"))


@query("SELECT l_returnflag AS band, sum(l_quantity)::BIGINT AS bytes, count(*) AS files FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def storage_summary(spark, d):
    return table(spark, d, "lineitem").rollup(F.col("l_returnflag").alias("band")).agg(F.sum("l_quantity").cast("long").alias("bytes"), F.count(F.lit(1)).alias("files"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_orderkey FROM r WHERE n <= 4 OR list_contains(list_transform(range(0, 4), lambda k: floor(k * (n - 1) / 3.0 + 0.5)::BIGINT), i)""")
def even_subsample(spark, d):
    return S.even_subsample(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 4).select("o_custkey", "o_orderkey")


@query("SELECT c_custkey, substr(sha1(c_name || '|' || c_mktsegment || '|' || c_nationkey), 1, 8) AS key FROM customer")
def identity_hash(spark, d):
    return table(spark, d, "customer").select("c_custkey", B.window_key(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("key"))


@query("""WITH x AS (SELECT s_suppkey, 'S2A_T' || lpad((1 + s_suppkey % 60)::VARCHAR, 2, '0') || chr((67 + s_suppkey % 20)::INT) || 'PQ_N' AS id, ['B02','B08','SCL','B8A','AOT'][(1 + s_suppkey % 5)::INT] AS band FROM supplier)
SELECT s_suppkey, CASE WHEN regexp_extract(id, '_T(\\d{2})([A-Z])[A-Z]{2}', 2) >= 'N' THEN 32600 ELSE 32700 END + regexp_extract(id, '_T(\\d{2})', 1)::INT AS epsg,
CASE WHEN band = 'SCL' THEN 'mask' WHEN band = 'B08' THEN 'reference' WHEN band LIKE 'B%' THEN 'reflectance' ELSE 'data' END AS role FROM x""")
def mgrs_parse(spark, d):
    k = F.col("s_suppkey")
    item = F.concat(F.lit("S2A_T"), F.lpad((1 + k % 60).cast("string"), 2, "0"), F.chr(67 + k % 20), F.lit("PQ_N"))
    band = F.element_at(F.array(*map(F.lit, ("B02", "B08", "SCL", "B8A", "AOT"))), (1 + k % 5).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", B.mgrs_epsg(item).alias("epsg"), B.band_role(band).alias("role"))


@query("SELECT count(DISTINCT l_suppkey) AS granules, count(DISTINCT l_orderkey) AS cells, round(count(DISTINCT l_suppkey) * 3 * 0.09::DOUBLE, 6) AS gb, round(count(DISTINCT l_orderkey) * 5 * 1.79::DOUBLE / 60, 6) AS minutes FROM lineitem")
def estimate_cost(spark, d):
    x = table(spark, d, "lineitem").agg(F.count_distinct("l_suppkey").alias("granules"), F.count_distinct("l_orderkey").alias("cells"))
    return x.select("*", F.round(F.col("granules") * 3 * 0.09, 6).alias("gb"), F.round(F.col("cells") * T * 1.79 / 60, 6).alias("minutes"))


@query("""WITH a AS (SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY ALL),
x AS (SELECT user_id, min(ts) AS t, string_agg('"' || event_type || '":{"href":"/data/' || event_type || '.tif","type":"image/tiff"}', ',' ORDER BY event_type) AS s FROM a GROUP BY 1)
SELECT user_id, '{"type":"Feature","id":"' || user_id || '","properties":{"datetime":"' || strftime(t, '%Y-%m-%dT%H:%M:%SZ') || '"},"assets":{' || s || '}}' AS item FROM x""")
def stac_items_json(spark, d):
    x = table(spark, d, "events").groupBy("user_id").agg(F.date_format(F.min("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"), F.map_from_entries(F.array_sort(F.collect_set(F.struct("event_type", F.struct(F.concat(F.lit("/data/"), "event_type", F.lit(".tif")).alias("href"), F.lit("image/tiff").alias("type")))))).alias("assets"))
    return x.select("user_id", F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("user_id").cast("string").alias("id"), F.struct("datetime").alias("properties"), "assets")).alias("item"))

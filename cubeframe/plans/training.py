"""Registered queries from cubes to training rows, from predictions to outputs, and on requests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from cubeframe.functions.bands import scaled
from cubeframe.operators import requests as R
from cubeframe.operators import training as L
from cubeframe.plans.queries import query
from cubeframe.plans.tools import _TILES, _tiles
from cubeframe.sources.tables import table

c, lit = F.col, F.lit
#: Cubes of orders: a row for each line, bands quantity and (rounded) discount.
_CUBE = "q AS (SELECT l_orderkey AS id, l_linenumber % 2 AS r, l_linenumber // 2 AS k, l_linenumber AS t, l_quantity::INT AS b1, round(l_discount * 100)::INT AS b2 FROM lineitem)"


def _cubes(spark, d):
    n = c("l_linenumber")
    return table(spark, d, "lineitem").select(
        c("l_orderkey").alias("id"), (n % 2).alias("row"), F.floor(n / 2).cast("int").alias("col"), n.alias("t"), c("l_quantity").cast("int").alias("b1"), F.round(c("l_discount") * 100).cast("int").alias("b2")
    )


def _rows(spark, d):
    labels = table(spark, d, "orders").select(c("o_orderkey").alias("id"), c("o_orderstatus").alias("label"))
    return L.training_rows(_cubes(spark, d), labels, "id", "t", ["b1", "b2"], (c("id") * 10.0, lit(0.0)), lit(10.0))


@query(f"""WITH {_CUBE}, f AS (SELECT id, r, k, array_to_string(flatten(list([b1, b2] ORDER BY t, b1, b2)), ',') AS features FROM q GROUP BY ALL HAVING bool_or(b1 <> 0 OR b2 <> 0))
SELECT f.id, f.r AS row, f.k AS col, (f.id * 10 + f.k * 10 + 5)::DOUBLE AS x, (-(f.r * 10 + 5))::DOUBLE AS y, features, o_orderstatus AS label FROM f JOIN orders ON o_orderkey = f.id""")
def training_rows(spark, d):
    return _rows(spark, d).withColumn("features", F.array_join(F.transform("features", lambda v: v.cast("string")), ","))


@query(f"""WITH {_CUBE}, f AS (SELECT id, r, k, flatten(list([b1, b2] ORDER BY t, b1, b2)) AS v FROM q GROUP BY ALL HAVING bool_or(b1 <> 0 OR b2 <> 0)),
e AS (SELECT id, unnest(v) AS v, generate_subscripts(v, 1) AS i FROM f), m AS (SELECT id, i, median(v) AS v FROM e GROUP BY ALL)
SELECT m.id, o_orderstatus AS label, count(*) AS n, round(sum(v * i), 4) AS weighed FROM m JOIN orders ON o_orderkey = m.id GROUP BY ALL""")
def training_medians(spark, d):
    out = L.aggregated(_rows(spark, d), "id", "median_per_id")
    weighed = F.aggregate(F.transform("features", lambda v, i: v * (i + 1)), lit(0.0), lambda a, b: a + b)
    return out.select("id", "label", F.size("features").cast("long").alias("n"), F.round(weighed, 4).alias("weighed"))


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - 10) / 2 - 1, 6) AS l_quantity FROM lineitem")
def feature_steps(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    steps = [(scaled, {"names": ["l_quantity"], "mean": 10.0, "std": 2.0}), (lambda df, by: df.withColumn("l_quantity", F.round(c("l_quantity") - by, 6)), {"by": 1})]
    return L.features(x, steps=steps)


@query("""SELECT l_orderkey AS cube, 0 AS row, l_linenumber AS col, max(l_quantity) AS B04, max(l_tax) AS B08 FROM lineitem GROUP BY ALL""")
def stack_bands(spark, d):
    x = table(spark, d, "lineitem").select(c("l_orderkey").alias("cube"), lit(0).alias("row"), c("l_linenumber").alias("col"), lit("10 m").alias("grid"), F.explode(F.create_map(lit("B04"), c("l_quantity"), lit("B08"), c("l_tax"))).alias("band", "dn"))
    return L.stacked(x, ["cube"], ["B04", "B08"])


@query("SELECT p_partkey FROM part WHERE abs(p_partkey * 37 % 360 + 0.25 - 180) + abs(p_partkey * 53 % 170 + 0.5 - 85) < 60")
def crop_pixels(spark, d):
    point = lambda x, y: F.struct(lit(float(x)).alias("x"), lit(float(y)).alias("y"))
    diamond = F.array(F.array(point(120, 85), point(180, 25), point(240, 85), point(180, 145)))
    k = c("p_partkey")
    return L.crop(table(spark, d, "part").select("p_partkey"), diamond, k * 37 % 360 + lit(0.25), k * 53 % 170 + lit(0.5))


@query("""SELECT vec_id, generate_subscripts(embedding, 1)::INT AS band, trunc(unnest(embedding) * 1000)::INT AS value FROM embeddings""")
def output_bands(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v * lit(1000.0).cast("float")).alias("p"))
    return L.output_bands(x, ["vec_id"], "p", "int")


@query("SELECT vec_id, CASE WHEN label % 2 = 0 THEN label ELSE -1 END::DOUBLE AS prediction FROM embeddings")
def scatter_predictions(spark, d):
    x = table(spark, d, "embeddings")
    return L.scattered(x, x.where("label % 2 = 0").withColumn("prediction", c("label").cast("double")), ["vec_id"], "prediction", -1.0)


_OUT = "SELECT l_orderkey % 50 AS x, l_suppkey AS y, l_orderkey * 10 + l_linenumber AS seq, 'EPSG:' || (32630 + (l_suppkey % 3 = 0)::INT) AS crs, CASE WHEN l_returnflag = 'A' THEN 0 ELSE l_quantity END AS v FROM lineitem"


@query(f"""WITH o AS ({_OUT}), m AS (SELECT arg_max(crs, row(n, crs)) AS ref FROM (SELECT crs, count(*) AS n FROM o GROUP BY 1))
SELECT crs, x, y, coalesce(arg_min(v, row(seq, v)) FILTER (v <> 0), 0) AS v FROM o, m WHERE crs = ref GROUP BY ALL""")
def merge_outputs(spark, d):
    crs = F.concat(lit("EPSG:"), (32630 + (c("l_suppkey") % 3 == 0).cast("int")).cast("string"))
    x = table(spark, d, "lineitem").select((c("l_orderkey") % 50).alias("x"), c("l_suppkey").alias("y"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("seq"), crs.alias("crs"), F.when(c("l_returnflag") == "A", 0.0).otherwise(c("l_quantity")).alias("v"))
    return L.merge_outputs(x, "v", lit(0.0), to_dominant=True)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 4 = 1")
def identity_stamps(spark, d):
    o = table(spark, d, "orders")
    asked = R.identity({"bands": lit("B04,B08"), "days": lit(20), "id": c("o_custkey")})
    was = R.identity({"days": F.when(c("o_orderkey") % 4 == 1, 10).otherwise(20), "id": c("o_custkey"), "bands": lit("B04,B08")})
    return R.to_do(o.select("o_orderkey", asked.alias("identity")), o.where("o_orderstatus = 'F'").select("o_orderkey", was.alias("identity")), "o_orderkey").select("o_orderkey")


@query("""SELECT c_custkey, c_custkey * 2 AS seq, count(DISTINCT o_orderkey) AS tiles, min(o_orderdate) AS first, max(o_orderdate) AS last FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL""")
def work_units(spark, d):
    pairs = table(spark, d, "orders").select(c("o_custkey").alias("c_custkey"), c("o_orderkey").alias("id"), c("o_orderdate").alias("ts"))
    return R.work_units(pairs, table(spark, d, "customer").select("c_custkey", (c("c_custkey") * 2).alias("seq")), "c_custkey")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN -1000 WHEN 1 THEN p_size ELSE 0 END AS \"offset\", CASE p_partkey % 3 WHEN 0 THEN 0.0001 WHEN 1 THEN 0.5 ELSE 0.0001 END::DOUBLE AS scale FROM part")
def declarations(spark, d):
    k = c("p_partkey") % 3
    asked = F.when(k == 0, lit('{"version": 1, "offset": -1000}'))
    stamp = F.when(k <= 1, F.concat(lit('{"scale": 0.5, "offset": '), c("p_size").cast("string"), lit("}")))
    return table(spark, d, "part").withColumn("made", R.resolved(asked, stamp, True)).select("p_partkey", "made.offset", "made.scale")


@query(f"""WITH t AS ({_TILES}) SELECT satellite, count(*) AS items, count(DISTINCT substr(id, 1, 9)) AS tiles, count(DISTINCT substr(id, 1, 9)) = 1 AS single_tile, 'B02,B08' AS present, 'B11' AS missing,
array_to_string(list_sort(list(DISTINCT "offset")), ',') AS offsets, date_diff('day', min(ts), max(ts)) AS days FROM t GROUP BY 1""")
def archive_check(spark, d):
    return R.archive_check(_tiles(spark, d).withColumn("tile", F.substring("id", 1, 9)), "satellite", ["B02", "B08", "B11"])


@query(f"""WITH t AS ({_TILES}) SELECT id, cloud_cover FROM t WHERE cloud_cover <= 20 AND xmin <= 30""")
def refined_items(spark, d):
    return R.refined(_tiles(spark, d), c("xmin") <= 30, 20.0).select("id", "cloud_cover")


@query(f"""WITH t AS ({_TILES}) SELECT satellite, array_to_string(list_sort(list(DISTINCT (ts::DATE)::VARCHAR)), ',') AS days FROM t
WHERE ts BETWEEN TIMESTAMP '2018-01-02' AND TIMESTAMP '2018-01-09' GROUP BY 1""")
def granules_in_order(spark, d):
    t = _tiles(spark, d).where(c("ts").between(lit(datetime(2018, 1, 2)), lit(datetime(2018, 1, 9))))
    days = t.select("satellite", F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct()
    return days.groupBy("satellite").agg(F.array_join(F.array_sort(F.collect_list("day")), ",").alias("days"))

"""Registered reports and raster queries, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cubeframe.operators import raster as R
from cubeframe.plans.queries import OBS, query
from cubeframe.sources.tables import observations, table


@query("""WITH g AS (SELECT date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate) AS gap FROM orders)
SELECT gap::INT AS gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1""")
def gap_histogram(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    gap = F.date_diff("o_orderdate", F.lag("o_orderdate").over(w))
    return table(spark, d, "orders").select(gap.alias("gap")).where("gap IS NOT NULL").groupBy("gap").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < (SELECT min(o_orderdate)::DATE + INTERVAL 2 MONTH FROM orders)")
def first_n_months(spark, d):
    return R.first_months(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", 2).select("o_orderkey")


@query("""WITH y AS (SELECT o_orderpriority AS cores, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL)
SELECT a.cores, a.n AS a_n, b.n AS b_n, round(a.n / b.n::DOUBLE, 2) AS ratio FROM y a JOIN y b USING (cores) WHERE a.s = 'F' AND b.s = 'O'""")
def compare_sweeps(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("cores"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    side = lambda s, c: n.where(F.col("o_orderstatus") == s).select("cores", F.col("n").alias(c))
    return side("F", "a_n").join(side("O", "b_n"), "cores").withColumn("ratio", F.round(F.try_divide(F.col("a_n").cast("double"), F.col("b_n")), 2))


@query("""SELECT o_custkey, arg_min(o_totalprice, row(o_orderdate, o_orderkey)) AS first_point, arg_max(o_totalprice, row(o_orderdate, o_orderkey)) AS last_point,
round(arg_max(o_totalprice, row(o_orderdate, o_orderkey)) / arg_min(o_totalprice, row(o_orderdate, o_orderkey)), 4) AS ratio FROM orders GROUP BY 1""")
def curve_span(spark, d):
    at = F.struct("o_orderdate", "o_orderkey")
    x = table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_totalprice", at).alias("first_point"), F.max_by("o_totalprice", at).alias("last_point"))
    return x.withColumn("ratio", F.round(F.try_divide("last_point", "first_point"), 4))


@query(f"WITH {OBS} SELECT band, min(dn) AS low, max(dn) AS high, round(avg(CASE WHEN dn IS NULL THEN 1 ELSE 0 END), 6) AS nodata_share FROM obs GROUP BY 1")
def output_verdict(spark, d):
    return R.verdict(observations(spark, d), ["band"], "dn", F.lit(0))


@query("""SELECT l_returnflag AS label, round(median(l_quantity), 4) AS median, round(quantile_cont(l_quantity, 0.95), 4) AS p95, max(l_quantity) AS high, count(*) AS n FROM lineitem GROUP BY 1""")
def dataset_report(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("label")).agg(
        F.round(F.median(q), 4).alias("median"), F.round(F.percentile(q, 0.95), 4).alias("p95"), F.max(q).alias("high"), F.count(F.lit(1)).alias("n")
    )


@query("""WITH c AS (SELECT DISTINCT p_brand AS name, substr(md5(p_brand), 1, 6) AS h FROM part)
SELECT name, (row_number() OVER (ORDER BY name) - 1)::INT AS code, ('0x' || substr(h, 1, 2))::INT AS red, ('0x' || substr(h, 3, 2))::INT AS green, ('0x' || substr(h, 5, 2))::INT AS blue FROM c""")
def class_legend(spark, d):
    return R.legend(table(spark, d, "part").select(F.col("p_brand").alias("name")), "name", F.substring(F.md5("name"), 1, 6))


@query("""WITH s AS (SELECT (p_partkey // 20)::INT AS r, (p_partkey % 20)::INT AS c, p_size AS dn FROM part),
g AS (SELECT DISTINCT r AS r, c AS c FROM s)
SELECT g.r AS row, g.c AS col, coalesce(s.dn, 0) AS dn FROM g LEFT JOIN s ON s.r = floor((g.r + 0.5) * 1.5)::INT AND s.c = floor((g.c + 0.5) * 1.5)::INT""")
def nearest_resample(spark, d):
    k = F.col("p_partkey")
    s = table(spark, d, "part").select(F.floor(k / 20).cast("int").alias("row"), (k % 20).cast("int").alias("col"), F.col("p_size").alias("dn"))
    return R.resample_nearest(s, s.select("row", "col").distinct(), [], "dn", 1.5)

"""Per-pixel series: gaps, merges, flattening, features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_interpolate(df: DataFrame, keys: list[str], order: str, value: str, low: float = 0, high: float = 10000) -> DataFrame:
    """Values at or beyond the caps are missing and lie on the line between their neighbours by position; ends are held."""
    whole = Window.partitionBy(*keys).orderBy(order)
    back, on = whole.rowsBetween(Window.unboundedPreceding, 0), whole.rowsBetween(0, Window.unboundedFollowing)
    good = F.when((F.col(value) > low) & (F.col(value) < high), F.col(value))
    df = df.withColumn("_i", F.row_number().over(whole)).withColumn("_g", good).withColumn("_p", F.when(F.col("_g").isNotNull(), F.col("_i")))
    df = df.select("*", F.last("_g", True).over(back).alias("_pv"), F.last("_p", True).over(back).alias("_pi"), F.first("_g", True).over(on).alias("_nv"), F.first("_p", True).over(on).alias("_ni"))
    between = F.col("_pv") + (F.col("_nv") - F.col("_pv")) * (F.col("_i") - F.col("_pi")) / (F.col("_ni") - F.col("_pi"))
    filled = F.when(F.col("_g").isNotNull(), F.col("_g")).otherwise(F.coalesce(F.when(F.col("_ni") > F.col("_pi"), between), "_pv", "_nv", F.lit(0)))
    return df.withColumn(value, F.floor(filled).cast("int")).drop("_i", "_g", "_p", "_pv", "_pi", "_nv", "_ni")


def first_valid(df: DataFrame, keys: list[str], value: str, order: list[Column]) -> DataFrame:
    """The first value that is not missing, by ``order``; null if there is none."""
    return df.groupBy(*keys).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias(value))


def flatten(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """One row for each pixel that has any value: its series in time order, missing values as 0."""
    some = F.bool_or(F.exists(F.array(*[F.coalesce(F.col(v), F.lit(0)) for v in values]), lambda v: v != 0))
    row = F.struct(order, F.array(*[F.coalesce(F.col(v), F.lit(0)) for v in values]).alias("v"))
    out = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_s"), some.alias("_k")).where("_k")
    return out.select(*keys, F.flatten(F.transform("_s", lambda s: s["v"])).alias("features"))


def in_flight(intervals: DataFrame, lo: str, hi: str) -> DataFrame:
    """at, running: how many intervals are open after each moment. Moments are summed first; the window is over these."""
    moves = intervals.select(F.explode(F.array(F.struct(F.col(lo).alias("at"), F.lit(1).alias("d")), F.struct(F.col(hi).alias("at"), F.lit(-1).alias("d")))).alias("m"))
    by = moves.groupBy("m.at").agg(F.sum("m.d").alias("d"))
    # days are dealt by month; each month starts from the sum of those before it
    months = by.withColumn("_m", F.trunc("at", "month"))
    base = months.groupBy("_m").agg(F.sum("d").alias("_d")).select("_m", F.coalesce(F.sum("_d").over(Window.orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    run = F.sum("d").over(Window.partitionBy("_m").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return months.withColumn("_r", run).join(base, "_m").select("at", (F.col("_r") + F.col("_b")).alias("running"))


def even_subsample(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """At most ``n`` rows of each group, evenly spread, both ends among them."""
    w = Window.partitionBy(*keys)
    df = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(k * (F.col("_n") - 1) / F.lit(n - 1) + F.lit(0.5)))
    return df.where((F.col("_n") <= n) | F.array_contains(at, F.col("_i"))).drop("_i", "_n")

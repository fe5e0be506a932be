"""Tile catalogs and work lists: filters, upsert, de-duplication, what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(rows: DataFrame, key: str, seq: str, files: str, others: list[str]) -> DataFrame:
    """One row for each key: the sorted union of its file lists, everything else from the newest row."""
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*others), seq).alias("newest"))
    one = rows.select(key, F.explode(F.split(F.coalesce(files, F.lit("")), ",")).alias("file")).where("file <> ''").distinct()  # before they are collected
    lists = one.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("file")), ",").alias(files))
    return newest.join(lists, key, "left").select(key, *[F.col(f"newest.{c}").alias(c) for c in others], F.coalesce(files, F.lit("")).alias(files))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each group that is greatest by ``order``: a reduction that begins before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)])).alias("best"))
    return best.select(*[F.col(c) if c in keys else F.col("best").getField(c).alias(c) for c in df.columns])


def explode_files(df: DataFrame, files: str) -> DataFrame:
    """A row for each raster file; band is the name without its ending; side files go."""
    out = df.withColumn("file", F.explode(F.split(files, ","))).where(~F.col("file").endswith(".xml"))
    return out.withColumn("band", F.regexp_extract("file", r"([^/]*?)\.[^./]*$", 1))


def shortfall(needed: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    return needed.join(have.select(*keys), keys, "left_anti")


def plan_counts(needed: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """needed, present, missing as one row."""
    marked = needed.select(key).distinct().join(have.select(key).distinct().withColumn("_h", F.lit(1)), key, "left")
    return marked.agg(F.count(F.lit(1)).alias("needed"), F.count("_h").alias("present"), (F.count(F.lit(1)) - F.count("_h")).alias("missing"))


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, side: what only one of the two sets has."""
    one = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full")
    return one.where("_a IS NULL OR _b IS NULL").select(key, F.when(F.col("_b").isNull(), "only_left").otherwise("only_right").alias("side"))


def guard_unique(df: DataFrame, key: str) -> DataFrame:
    """``df``; reading it fails if a key stands twice."""
    n = df.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("ids"), F.max_by("id", "n").alias("worst"), F.max("n").alias("most"))
    said = F.concat(F.lit("repeated id "), F.col("worst").cast("string"), F.lit(" stands "), F.col("most").cast("string"), F.lit(" times; such ids: "), F.col("ids").cast("string"))
    fine = n.select(F.when(F.col("ids") > 0, F.raise_error(said)).otherwise(F.lit(True)).alias("fine"))
    return df.crossJoin(F.broadcast(fine)).where("fine").select(*df.columns)  # one row

"""Connected components by alternating large-star and small-star steps.

Where there are many edges, each step writes what every node points to and then joins it with the edges: both sides of
that join are plain shuffles of files, so that adaptive execution can split a node with very many edges over several
tasks. Few edges need no splitting: both steps of a round are one job then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeframe.llm.common import discard, materialise

#: Edges from which on a node's may be too many for a task.
MANY = 5_000_000


def _star(edges: DataFrame, small: bool, many: bool, name: str) -> DataFrame:
    """large-star: larger neighbours go to the least neighbour; small-star: smaller neighbours and the node itself do."""
    both = edges if small else edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    if many:
        least = materialise(least, f"{name}-least")
    joined = both.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
    if small:  # every edge points to the smaller node
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        out = joined.where("v > u OR u > m").select(F.greatest("u", "v").alias("u"), F.col("m").alias("v"))
    out = out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    if many or small:
        out = materialise(out, name)
    if many:
        discard(least)
    return out


def connected_components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """(u, v): every node that has an edge, the least node of its component aside, with that least node.

    ``edges``: two columns u, v of one orderable type; loops and repeated rows do no harm.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, last = materialise(now, name), None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == last or not seen[0]:
            return now
        last, many, before = seen, seen[0] > MANY, now
        large = _star(now, False, many, name)
        now = _star(large, True, many, name)
        discard(before)
        if many:
            discard(large)

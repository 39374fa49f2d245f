"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (u, v) to rows (node, root), root being the smallest node of the component.

    Only nodes that have an edge to another node appear. Rounds go on until nothing changes, which takes about the logarithm of
    the longest path; every one cuts its lineage with a reliable checkpoint, and a few numbers come back to the driver.
    """
    stars = cut_lineage(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct())
    mark = None
    while True:
        stars = cut_lineage(_small_star(_large_star(stars)))
        seen = tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v"))).first())
        if seen == mark:
            break
        mark = seen
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()

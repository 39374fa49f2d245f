"""Containment of boxes in boxes, as an equi-join over grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORNERS = ("x0", "y0", "x1", "y1")


def contained(inner: DataFrame, outer: DataFrame, group: str, inner_id: str, outer_id: str, slack: float = 0.0, most_crowded: int = 20_000) -> DataFrame:
    """(group, inner_id, outer_id) of each box of ``inner`` that lies within a box of ``outer`` of its group, edges and ``slack`` included.

    Both have (group, id, x0, y0, x1, y1). An outer box is dealt to the cells of a grid as wide as the next power of two over its
    longer side, four at most; an inner box asks, in each grid that there is, for the cell of its corner. So a pair meets in one
    cell, once, and no two boxes are compared that don't share one. Cells with more than 1 / ``most_crowded`` of all questions are
    fewer than ``most_crowded``: their numbers are broadcast, their questions dealt to several tasks and their outer boxes sent to each of
    these. Boxes with a null corner, group or id, or whose ends are before their begins, take no part.
    """
    whole = lambda df, own: df.where(" AND ".join(f"{c} IS NOT NULL" for c in (group, own, *CORNERS)) + " AND x0 <= x1 AND y0 <= y1").select(F.col(group).alias("g"), F.col(own).alias("id"), *[F.col(c).cast("double").alias(c) for c in CORNERS])
    a, b = whole(inner, inner_id), whole(outer, outer_id)
    wide = b.select("g", "id", *[(F.col(c) + (-slack if c[1] == "0" else slack)).alias(c) for c in CORNERS])
    side = F.greatest(F.lit(1.0), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    wide = wide.withColumn("level", F.ceil(F.log2(side)).cast("int"))
    cell = lambda c, level: F.floor(F.col(c) / F.pow(F.lit(2.0), level)).cast("long")
    along = lambda axis: F.explode(F.sequence(cell(f"{axis}0", F.col("level")), cell(f"{axis}1", F.col("level"))))
    boxes = wide.withColumn("cx", along("x")).withColumn("cy", along("y"))
    levels = sorted(r[0] for r in wide.select("level").distinct().collect())  # powers of two
    if not levels:
        return a.join(b.select("g", F.col("id").alias("o")), "g").limit(0).select(F.col("g").alias(group), F.col("id").alias(inner_id), F.col("o").alias(outer_id))
    asked = a.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    asked = asked.withColumns({"cx": cell("x0", F.col("level")), "cy": cell("y0", F.col("level"))})
    key = ["g", "level", "cx", "cy"]
    counts = asked.groupBy(*key).agg(F.count("*").alias("n"))
    most = F.greatest(F.lit(1_000), F.ceil(F.lit(a.count() * len(levels)) / most_crowded))
    crowded = F.broadcast(counts.where(F.col("n") > most).select(*key, F.ceil(F.col("n") / most).cast("int").alias("shares")))
    shares: Column = F.coalesce("shares", F.lit(1))
    left = asked.join(crowded, key, "left").withColumn("share", F.pmod(F.xxhash64("id", "x0", "y0"), shares).cast("int")).drop("shares")
    right = boxes.join(crowded, key, "left").withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("shares")
    both = left.alias("i").join(right.alias("o"), [*key, "share"])
    inside = (F.col("i.x0") >= F.col("o.x0")) & (F.col("i.y0") >= F.col("o.y0")) & (F.col("i.x1") <= F.col("o.x1")) & (F.col("i.y1") <= F.col("o.y1"))
    return both.where(inside).select(F.col("g").alias(group), F.col("i.id").alias(inner_id), F.col("o.id").alias(outer_id))

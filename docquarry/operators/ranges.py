"""Numbers and scans over ordered groups of any size.

A window over a group puts the whole group into one task. Here rows are range-partitioned by (group, order), so a
large group spreads over as many partitions as it needs; each partition works on its own part of a group,
and one summary row for each part, a few for each partition, carries what came before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.session import cut_lineage


def in_ranges(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows with ``__part``, their range partition; cut off from the plan, so that every use sees the same ranges."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(parts, *group, *order).withColumn("__part", F.spark_partition_id()))


def row_numbers(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "n") -> DataFrame:
    """The rows with their number from 1 in their group, in order; ``order`` should tell rows apart."""
    placed = in_ranges(df, group, order)
    local = F.row_number().over(Window.partitionBy("__part", *group).orderBy(*order)).cast("long")
    sizes = placed.groupBy("__part", *group).agg(F.count("*").alias("__rows"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0))).drop("__rows")
    ranked = placed.withColumn(name, local)
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in ("__part", *group)]
    out = ranked.alias("r").join(offsets.alias("o"), same, "left")
    return out.select(*[F.col(f"r.{c}") for c in df.columns], (F.col(f"r.{name}") + F.col("o.__before")).alias(name))


def change_numbers(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str = "n", more: str = "has_next") -> DataFrame:
    """The rows with the number of changes of ``value`` up to them in their group, the first row counted, and whether a row follows.

    A null value is a value like any other.
    """
    placed = in_ranges(df, group, order)
    side = Window.partitionBy("__part", *group).orderBy(*order)
    changed = F.lag(F.lit(1)).over(side).isNotNull() & ~F.lag(value).over(side).eqNullSafe(F.col(value))
    local = placed.withColumns({"__inner": changed.cast("long"), "__last": F.lead(F.lit(1)).over(side).isNull()})
    local = local.withColumn("__sum", F.sum("__inner").over(side))
    parts = local.groupBy("__part", *group).agg(F.sum("__inner").alias("__changes"), F.min_by(F.struct(value), F.struct(*order)).alias("__first"), F.max_by(F.struct(value), F.struct(*order)).alias("__end"))
    ordered = Window.partitionBy(*group).orderBy("__part")
    edge = parts.withColumn("__edge", F.when(F.lag("__part").over(ordered).isNull(), F.lit(1)).otherwise((~F.lag("__end").over(ordered).eqNullSafe(F.col("__first"))).cast("long"))).withColumn("__more", F.lead("__part").over(ordered).isNotNull())
    upto = F.sum(F.col("__edge") + F.col("__changes")).over(ordered) - F.col("__changes")
    edge = edge.withColumn("__upto", upto).select("__part", *group, "__upto", "__more")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in ("__part", *group)]
    out = local.alias("r").join(edge.alias("o"), same, "left")
    return out.select(*[F.col(f"r.{c}") for c in df.columns], (F.col("r.__sum") + F.col("o.__upto")).alias(name), (~F.col("r.__last") | F.col("o.__more")).alias(more))


def scan(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    xors: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    lags: Mapping[str, tuple[Column, int]] | None = None,
    leads: Mapping[str, Column] | None = None,
) -> DataFrame:
    """The rows with running states of their group, in order, the row itself counted; ``order`` should tell rows apart.

    sums and xors: of all values so far, null counting as 0. lasts: the last value so far that isn't null. lags: the
    value one or two rows before, leads: of the next row; both null where there is no such row. All of these are
    associative, so a partition needs one row of what came before it and what comes after: two rows a partition are broadcast.
    """
    sums, xors, lasts, lags, leads = ({**(x or {})} for x in (sums, xors, lasts, lags, leads))
    zero = F.lit(0).cast("long")
    values = {f"__s_{k}": F.coalesce(c.cast("long"), zero) for k, c in sums.items()} | {f"__x_{k}": F.coalesce(c.cast("long"), zero) for k, c in xors.items()} | {f"__l_{k}": c for k, c in lasts.items()}
    own = F.struct(F.lit(1).alias("__row"), *[c.alias(f"b_{k}") for k, (c, _) in lags.items()], *[c.alias(f"a_{k}") for k, c in leads.items()])
    placed = in_ranges(df.withColumns(values | {"__own": own}), group, order)
    side = Window.partitionBy("__part", *group).orderBy(*order)
    upto, key = side.rowsBetween(Window.unboundedPreceding, Window.currentRow), F.struct(*order)
    running = {f"__s_{k}": F.sum(f"__s_{k}").over(upto) for k in sums} | {f"__x_{k}": F.bit_xor(f"__x_{k}").over(upto) for k in xors} | {f"__l_{k}": F.last(f"__l_{k}", ignorenulls=True).over(upto) for k in lasts}
    local = placed.withColumns(running | {"__i": F.row_number().over(side), "__prev": F.lag("__own").over(side), "__prev2": F.lag("__own", 2).over(side), "__next": F.lead("__own").over(side)})
    ends = local.groupBy("__part", *group).agg(F.max_by(F.struct(*running, "__own", "__prev"), key).alias("end"), F.min_by("__own", key).alias("begin"))
    parts = Window.partitionBy(*group).orderBy("__part")
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    carried = {f"__s_{k}": F.sum(f"end.__s_{k}").over(before) for k in sums} | {f"__x_{k}": F.bit_xor(f"end.__x_{k}").over(before) for k in xors} | {f"__l_{k}": F.last(f"end.__l_{k}", ignorenulls=True).over(before) for k in lasts}
    carry = ends.withColumns(carried | {"__tail": F.lag("end.__own").over(parts), "__tail2": F.coalesce(F.lag("end.__prev").over(parts), F.lag("end.__own", 2).over(parts)), "__head": F.lead("begin").over(parts)})
    carry = carry.where(F.col("__tail").isNotNull() | F.col("__head").isNotNull())  # groups that go on from or into another partition
    r, o = (lambda c: F.col(f"r.{c}")), (lambda c: F.col(f"o.{c}"))
    out = local.alias("r").join(F.broadcast(carry.select("__part", *group, *carried, "__tail", "__tail2", "__head")).alias("o"), [r(c).eqNullSafe(o(c)) for c in ("__part", *group)], "left")
    prev = F.coalesce(r("__prev"), o("__tail"))
    prev2 = F.coalesce(r("__prev2"), F.when(r("__i") == 2, o("__tail")).when(r("__i") == 1, o("__tail2")))
    after = F.coalesce(r("__next"), o("__head"))
    made = [(r(f"__s_{k}") + F.coalesce(o(f"__s_{k}"), zero)).alias(k) for k in sums] + [r(f"__x_{k}").bitwiseXOR(F.coalesce(o(f"__x_{k}"), zero)).alias(k) for k in xors]
    made += [F.coalesce(r(f"__l_{k}"), o(f"__l_{k}")).alias(k) for k in lasts] + [(prev, prev2)[n - 1][f"b_{k}"].alias(k) for k, (_, n) in lags.items()] + [after[f"a_{k}"].alias(k) for k in leads]
    return out.select(*[r(c) for c in df.columns], *made)


def spread_join(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size_col: str, most_hot: int = 20_000) -> DataFrame:
    """Inner join of rows with their groups (keys, size_col, ...), one row a group, size_col being its number of rows; keys aren't null.

    Groups of more than 1 / ``most_hot`` of all rows are fewer than ``most_hot``, and are broadcast; no other key is hot.
    """
    groups = cut_lineage(groups)
    total = groups.agg(F.coalesce(F.sum(size_col), F.lit(0))).first()[0]
    hot = groups.where(F.col(size_col) > max(1_000, total // most_hot))
    names = F.broadcast(hot.select(*keys))
    rest = rows.join(names, list(keys), "left_anti").join(groups.join(names, list(keys), "left_anti"), list(keys))
    return rows.join(F.broadcast(hot), list(keys)).unionByName(rest).drop(size_col)

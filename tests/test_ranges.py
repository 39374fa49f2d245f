"""Scans over spread groups, against one-task windows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docquarry.operators import ranges as R


@pytest.mark.parametrize("parts", ["1", "3", "16"])
def test_numbers_equal_windows(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    df = spark.range(800).select(F.when(F.col("id") % 5 < 4, "hot").when(F.col("id") % 50 == 4, None).otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"), F.col("id").alias("o"), (F.floor(F.col("id") / 11) % 3).cast("string").alias("v"))
    side = Window.partitionBy("g").orderBy("o")
    want = df.withColumn("n", F.row_number().over(side).cast("long"))
    assert sorted(map(tuple, R.row_numbers(df, ("g",), ("o",)).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    changed = (F.lag("v").over(side).isNull() | (F.lag("v").over(side) != F.col("v"))).cast("long")
    want = df.withColumn("c", changed).withColumn("n", F.sum("c").over(side)).withColumn("has_next", F.lead("o").over(side).isNotNull()).drop("c")
    got = R.change_numbers(df, ("g",), ("o",), "v")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("parts", ["1", "16"])
def test_null_values_change_like_any_other(spark, parts):
    """Nulls are one value, inside a partition and across its border."""
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    for value in (F.lit(None).cast("string"), F.when(F.col("id") % 10 < 5, "a")):
        df = spark.range(40).select(F.lit("g").alias("g"), F.col("id").alias("o"), value.alias("v"))
        got = {r.o: r.n for r in R.change_numbers(df, ("g",), ("o",), "v").collect()}
        values = [r.v for r in df.orderBy("o").collect()]
        assert [got[i] for i in range(40)] == [1 + sum(a != b for a, b in zip(values[:i], values[1 : i + 1], strict=True)) for i in range(40)]
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty(spark):
    none = spark.createDataFrame([], "g string, o long, v string")
    assert R.row_numbers(none, ("g",), ("o",)).collect() == [] == R.change_numbers(none, ("g",), ("o",), "v").collect()


def test_scan_equals_a_loop(spark):
    import random

    from pyspark.sql import functions as F

    from docquarry.operators.ranges import scan

    rng = random.Random(3)
    rows = [(g, i, rng.choice([None, *range(9)]), rng.choice([None, "a", "b"])) for g, n in (("hot", 700), (None, 40), ("two", 2), ("one", 1), *((f"g{k}", 5) for k in range(30))) for i in range(n)]
    shuffled = rng.sample(rows, len(rows))
    want = []
    for group in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == group]
        total, xor, last = 0, 0, None
        for k, (g, i, v, s) in enumerate(own):
            total, xor, last = total + (v or 0), xor ^ (v or 0), s if s is not None else last
            want.append((g, i, v, s, total, xor, last, own[k - 1][2] if k else None, own[k - 2][3] if k > 1 else None, own[k + 1][3] if k + 1 < len(own) else None))
    df = spark.createDataFrame(shuffled, "g string, i int, v int, s string").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("1", "4", "60"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = scan(df, ["g"], ["i"], sums={"total": F.col("v")}, xors={"xor": F.col("v")}, lasts={"last": F.col("s")}, lags={"v1": (F.col("v"), 1), "s2": (F.col("s"), 2)}, leads={"s_next": F.col("s")}).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert scan(df.where("false"), ["g"], ["i"], sums={"t": F.col("v")}).count() == 0

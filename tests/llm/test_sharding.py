import itertools
import random
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from docquarry.llm import sharding
from tests.conftest import SF
from tests.llm import fixtures


def shards_of(df, **more):
    rows = sharding.shard_by_bytes(df, **more).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    return rows, by


@pytest.mark.parametrize("part_bytes", [1 << 25, 20_000])
def test_given_documents(spark, part_bytes):
    from docquarry.session import table

    docs = table(spark, SF, "documents")
    rows, by = shards_of(docs, part_bytes=part_bytes)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.text for r in rows} == texts and len(rows) == len(texts)
    assert all(r.size == len(r.text.encode()) + 1 for r in rows)
    total = sum(r.size for r in rows)
    largest = max(r.size for r in rows)
    assert sorted(by) == list(range(8))
    assert all(abs(sum(r.size for r in v) - total / 8) <= 2 * largest for v in by.values())


def test_digest(spark):
    rows = sharding.sharded_digest(fixtures.odd(spark)).collect()
    assert len(rows) == 11
    assert all(r.law == "bytes" and r.grown_shard is None for r in rows)
    assert {r.text_crc32 for r in rows if r.doc_id in (1, 2)} == {0}
    assert {r.size for r in rows if r.doc_id in (1, 2)} == {1}
    assert {r.text_crc32 for r in rows if r.doc_id == 4} == {zlib.crc32(b"one")}


def test_hot_group_is_cut_only_between_ids(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("one text of many copies")).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    _, by = shards_of(df)
    sizes = [sum(r.size for r in v) for v in by.values()]
    assert len(by) == 8 and max(sizes) < 1.03 * min(sizes)


def test_small_groups_stay_together(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.floor(F.col("id") / 4).cast("string")).alias("text"))
    rows, by = shards_of(df)
    where = {}
    for r in rows:
        where.setdefault(r.text, set()).add(r.shard)
    assert all(len(v) == 1 for v in where.values())
    sizes = [sum(r.size for r in v) for v in by.values()]
    assert max(sizes) < 1.03 * min(sizes)


def by_hand(rows, shards, slack):
    """Rows (text, id) to (shard, slot) by one sort, or None where rows with one key have to be cut."""
    key = lambda r: (xxhash.xxh64_intdigest((r[0] or "").encode(), 42), -1 if r[1] is None else r[1] + (1 << 63))
    signed = lambda k: ((k[0] ^ (1 << 63)), k[1])
    order = sorted(rows, key=lambda r: signed(key(r)))
    sizes = [len((t or "").encode()) + 1 for t, _ in order]
    below = [0, *itertools.accumulate(sizes)]
    share = below[-1] / shards
    cuts = []
    for i in range(1, shards):
        goal = share * i
        near = lambda at: min(at, key=lambda p: (abs(below[p] - goal), p))
        texts = [p for p in range(len(order) + 1) if p in (0, len(order)) or key(order[p])[0] != key(order[p - 1])[0]]
        best = near(texts)
        if abs(below[best] - goal) > share * slack:
            best = near([p for p in range(len(order) + 1) if p in (0, len(order)) or key(order[p]) != key(order[p - 1])])
        cuts.append((abs(below[best] - goal), best))
    return order, [0, *(c for _, c in cuts), len(order)], share, sizes


def test_against_one_sort(spark):
    """Splitters lie as near to their goals as any boundary between texts within the slack, or between rows; slots are ranks."""
    rng = random.Random(5)
    rows = [(rng.choice(["hot copy " * 5, "a" * rng.randrange(200), f"text {i}"]), i if rng.random() < 0.9 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "text string, doc_id long")
    order, cuts, share, sizes = by_hand(rows, 8, 0.005)
    got = sharding.shard_by_bytes(df).collect()
    assert sorted((r.text, str(r.doc_id)) for r in got) == sorted((t, str(i)) for t, i in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    placed = [(r.text, r.doc_id) for k in range(8) for r in sorted(by.get(k, []), key=lambda r: r.slot)]
    key = lambda r: (r[0], str(r[1]))
    assert list(map(key, placed)) == list(map(key, order))
    ends = list(itertools.accumulate(len(by.get(k, [])) for k in range(7)))
    below = [0, *itertools.accumulate(sizes)]
    for i, (end, best) in enumerate(zip(ends, cuts[1:8], strict=True), 1):
        miss, least = abs(below[end] - share * i), abs(below[best] - share * i)
        assert miss <= max(least, share * 0.005) + 1e-9


def test_null_ids_and_equal_rows_are_cut(spark):
    """Equal rows and copies without an id are spread like any others."""
    copies = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"))
    texts = spark.range(2000).select("id", F.concat(F.lit("text "), F.col("id").cast("string")))
    equal = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same row").alias("text"))
    for df in (copies, copies.union(texts), equal, equal.union(texts).union(copies)):
        rows, by = shards_of(df)
        sizes = [sum(r.size for r in by.get(k, [])) for k in range(8)]
        share = sum(sizes) / 8
        assert len(rows) == df.count() and all(abs(s - share) <= share * 0.01 + 13 for s in sizes)


def test_other_columns_stay(spark):
    df = spark.range(20).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), (F.col("id") * 2).alias("__hash"), (F.col("id") * 3).alias("__part"), F.lit("x").alias("__row"), F.lit(5).alias("slot"))
    rows, _ = shards_of(df)
    assert set(rows[0].asDict()) == {"doc_id", "text", "__hash", "__part", "__row", "size", "shard", "slot"}
    assert all((r["__hash"], r["__part"], r["__row"]) == (r.doc_id * 2, r.doc_id * 3, "x") for r in rows)


def test_equal_rows_and_empty(spark):
    same = spark.createDataFrame([(1, "x")] * 50, "doc_id long, text string")
    rows, by = shards_of(same)
    assert len(rows) == 50 and len(by) == 8 and {len(v) for v in by.values()} <= {6, 7}
    assert sharding.shard_by_bytes(fixtures.empty(spark)).collect() == []

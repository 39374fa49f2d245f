"""Exact dedup against one dictionary of whole texts, and odd rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from docquarry.llm import exactdedup

SCHEMA = "doc_id long, text string"


def brute(rows):
    bare = lambda t: (t or "").translate({ord(c): None for c in exactdedup.BLANKS})
    groups = {}
    for doc, text in rows:
        groups.setdefault(bare(text), []).append((doc, text))
    out = []
    for key, own in groups.items():
        rank = lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)
        best = min(own, key=rank)
        taken = False
        for r in own:
            kept = not taken and rank(r) == rank(best)
            taken |= kept
            out.append((r[0], best[0], len(own), kept, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=repr)


ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\f\r"), (4, "a b"), (5, "ab"), (6, "a\tb\n"), (7, "ba"), (8, "A b"), (9, "a b"), (10, "é ü"), (11, "éü"),
    (12, "x" * 70 + "1"), (13, "x" * 70 + "2"), (14, "x" * 70 + " 1"), (15, "y" * 100_000), (16, "y" * 50_000 + " " + "y" * 50_000), (17, "only one"),
    (18, "twin"), (18, "twin"), (18, "twin"), (19, "t win"), (None, "no id"), (None, "no id"), (20, "noid"), (21, "퟿😀"), (22, "퟿ 😀"),
]


@pytest.mark.parametrize("slots", [1 << 20, 1])
def test_equals_a_dictionary(spark, monkeypatch, slots):
    """With one slot every row goes on to be hashed whole, with the same result."""
    monkeypatch.setattr(exactdedup, "SLOTS", slots)
    rows = [*ODD, *((100 + i, "hot text") for i in range(1_500)), *((5_000 + i, f"text {i % 90} of {'long' * (i % 5)}") for i in range(400))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = exactdedup.exact_duplicates(df, digest_all=True).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    assert sum(r.kept for r in got) == len({r.digest for r in got})


def test_hashes_whole_texts_of_open_groups_only(spark):
    rows = [(1, "no other has this length"), (2, "a" * 64 + "1"), (3, "b" * 64 + "1"), (4, "same"), (5, "sa me")]
    got = {r.doc_id: r.digest for r in exactdedup.exact_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [k for k, v in sorted(got.items()) if v] == [4, 5]


def test_hot_groups_small_groups_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(exactdedup, "HOT_SHARE", 3)
    rows = [(i, "hot") for i in range(1_200)] + [(2_000 + i, f"t{i % 300}") for i in range(900)]
    got = exactdedup.exact_duplicates(spark.createDataFrame(rows, SCHEMA), digest_all=True)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    assert exactdedup.exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_other_columns_are_ignored(spark):
    names = ("slot", "bare", "prefix", "size", "points", "open", "digest", "rows", "first", "group_size", "by_length", "n")
    df = spark.createDataFrame(ODD, SCHEMA).select("*", *[F.lit("x").alias(c) for c in names])
    got = exactdedup.exact_duplicates(df, digest_all=True)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "digest"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(ODD)

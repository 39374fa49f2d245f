"""The trie against one dictionary of prefixes, the parentheses against a stack."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rebuilt(rows, share=True):
    held = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            held[c].append((turn is not None, turn or 0, role or "", sha(sha(role or "") + sha(text or "")), text or ""))
    convs = {c: [(r, x) for _, _, r, _, x in sorted(own)] for c, own in held.items()}
    opening = lambda c: zlib.crc32(str(c).encode()) % 6 if share else 0
    return {c: convs.get(c - int(math.fmod(c, 100)), [])[: opening(c)] + convs[c][opening(c) :] for c in convs}


def brute(convs):
    members, children, leaves, saved, out = defaultdict(set), defaultdict(list), {}, {}, []
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = sum(saved[x] for x in children[k]) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
        ends = ",".join(map(str, sorted(c for c in members[k] if len(convs[c]) == len(k))))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(children[k]), leaves[k], saved[k], sha(ends)))
    return sorted(out, key=repr)


def check(spark, rows, parts, monkeypatch=None):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sorted(map(tuple, trie.prefix_trie(trie.rebuilt_paths(df)).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == brute(rebuilt(rows))


@pytest.mark.parametrize("parts", ["1", "23"])
def test_equals_a_dictionary(spark, parts):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["u", None]), rng.choice(["a", "bb", "ccc"])) for c in range(300) for t in range(rng.choice([1, 2, 3, 5, 8, 13]))]
    rows += [(1_000 + c, t, "u", f"x{t}") for c in range(40) for t in range(c)]  # snapshots of one conversation
    rows += [(2_001 + c, t, "u", "same") for c in range(90) for t in range(7)]  # copies
    rows += [(5_000, t, "u", str(t % 3)) for t in range(1_500)]  # one very long one
    rows += [(5_001, None, None, None), (5_001, 2, "é", "日本"), (None, 1, "a", "b"), (5_002, 3, "z", "z"), (5_002, 3, "z", "z"), (-250, 0, "u", "a"), (-250, 1, "u", "b")]
    check(spark, rows, parts)


def test_one_conversation_and_none(spark):
    check(spark, [(7, 0, "user", "x" * 100_000)], "4")
    check(spark, [], "4")
    check(spark, [(None, 0, "u", "t")], "4")


def test_conversations_as_they_are_and_clashing_columns(spark):
    rows = [(c, t, "u", f"{c % (t + 1)}") for c in range(30) for t in range(c % 6)]
    names = ("part", "n", "mark", "points", "pos", "x1", "head", "own", "s", "tail_pos", "size", "key", "steps", "__part", "__own")
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in names])
    got = trie.prefix_trie(trie.plain_paths(df)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rebuilt(rows, share=False))


def test_ends_come_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS_PER_CHUNK", 7)
    check(spark, [(c, t, "u", str(t)) for c in range(200) for t in range(6 + (c == 3))], "5")


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 500, 40_000])
def test_findclose_equals_a_stack(n):
    rng = random.Random(n)
    opens, depth = [], 0
    for _ in range(n):
        up = depth == 0 or rng.random() < rng.choice([0.5, 0.9])
        opens.append(up)
        depth += 1 if up else -1
    opens += [False] * depth
    stack, want = [], {}
    for i, up in enumerate(opens):
        if up:
            stack.append(i)
        else:
            want[stack.pop()] = i
    at = np.array(sorted(want), np.int64)
    tree = trie.Parentheses(np.array(opens, bool))
    assert tree.findclose(at).tolist() == [want[i] for i in at.tolist()]
    if len(at):
        assert tree.leaf_rank[-1] == sum(a and not b for a, b in zip(opens, opens[1:], strict=False))


def test_deep_path_of_parentheses():
    n = 30_000
    tree = trie.Parentheses(np.array([True] * n + [False] * n))
    assert tree.findclose(np.arange(n)).tolist() == list(range(2 * n - 1, n - 1, -1))

"""Ranked search against scoring every pair, and the trees' bounds."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import lexical

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    bags = [(doc, Counter(terms(text))) for doc, text in docs]
    bags = [(doc, bag, sum(bag.values())) for doc, bag in bags if bag]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in {(i, t) for i, t in items if i is not None}:
        found = []
        for doc, bag, n in bags:
            m = 100 - 50 + 50 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 20 * m)) for t in set(terms(text)) if t in bag)
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def corpus(n, seed=5):
    rng = random.Random(seed)
    words = [*(f"w{i}" for i in range(120)), "É", "ß", "数据", "don't", "A1-b2", "naïve"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 3, 20, 90])))) for i in range(n)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 4, 25])))) for i in range(37)]
    return docs, items


def search(spark, docs, items, **more):
    got = lexical.ranked_search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), **more)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("more", [{}, {"k": 3, "seed_shares": (1,)}, {"group_bytes": 400}, {"seed_shares": ()}])
def test_equals_scoring_every_pair(spark, more):
    docs, items = corpus(900)
    docs += [(2_000 + i, "w3 w5 w90 copy") for i in range(120)] + [(None, "w3 w90"), (None, "w3 w90"), (7, "w90"), (3_000, None), (3_001, "?! -"), (3_002, "w1 " * 30_000)]
    items += [(None, "w1"), (50, None), (51, "--"), (1, items[1][1]), (52, "w90 copy"), (53, "W3 w3 É"), (54, "absent"), (0, "w2 w90")]
    if "group_bytes" in more:
        items = [x for x in items if x != (0, "w2 w90")]
    assert search(spark, docs, items, **more) == brute(docs, items, more.get("k", 50))


def test_nothing_to_search(spark):
    docs, items = corpus(5)
    assert search(spark, [], items) == search(spark, docs, []) == search(spark, [(1, None)], items) == search(spark, docs, [(1, "?")]) == []


def test_clashing_columns(spark):
    docs, items = corpus(60)
    odd = [F.lit("x").alias(c) for c in ("item", "part", "rank", "score", "n", "terms", "tfs")]
    got = lexical.ranked_search(spark.createDataFrame(docs, DOCS).select("*", F.lit(1).alias("item_id"), *odd), spark.createDataFrame(items, ITEMS).select("*", F.lit(1).alias("doc_id"), *odd))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items)


def test_bounds_prune_and_never_lose(monkeypatch):
    rng = np.random.default_rng(2)
    weights = rng.integers(1, 9_000, 400)
    topics = [rng.choice(400, 60, replace=False) for _ in range(8)]
    items = [np.sort(rng.choice(topics[i % 8], 20, replace=False)) for i in range(64)]
    docs = np.zeros((1024, 400))
    for d in range(1024):
        at = rng.choice(topics[d % 8], 25, replace=False)
        docs[d, at] = rng.integers(1_000, 900_000, 25)
    (block,) = lexical.blocks_of(items, weights)
    assert sorted(block.items.tolist()) == list(range(64)) and block.dtype is np.float64
    docs = docs[lexical.neighbours(block.affinities(docs[:, block.columns]), lexical.LEAF_DOCS)]
    scores = np.array([docs[:, own] @ weights[own] for own in items])
    least = np.sort(scores, axis=1)[:, -5]
    scored = 0
    real = lexical.np.ix_

    def counted(rows, columns):
        nonlocal scored
        scored += len(rows)
        return real(rows, columns)

    monkeypatch.setattr(lexical.np, "ix_", counted)
    found = {(item, int(d)): s for item, at, values in lexical.dual_search(block, docs[:, block.columns], least) for d, s in zip(at, values, strict=True)}
    want = {(i, d): scores[i, d] for i in range(64) for d in range(1024) if scores[i, d] >= least[i]}
    assert found == want
    assert scored < 0.5 * scores.size


def test_whole_numbers_beyond_doubles_stay_exact():
    items = [np.arange(3), np.arange(2)]
    (block,) = lexical.blocks_of(items, np.array([2**40, 2**40 + 1, 3]))
    assert block.dtype is np.int64
    docs = np.array([[2**20, 2**20 + 1, 5], [1, 0, 0]], np.int64)
    got = {item: list(map(int, s)) for item, _, s in lexical.dual_search(block, docs, np.zeros(2, np.int64))}
    assert got == {0: [2**60 + (2**40 + 1) * (2**20 + 1) + 15, 2**40], 1: [2**60 + (2**40 + 1) * (2**20 + 1), 2**40]}


def test_neighbours_are_an_order():
    for n in (1, 7, 8, 9, 100, 1023):
        points = np.random.default_rng(n).standard_normal((n, 6))
        assert sorted(lexical.neighbours(points, 8).tolist()) == list(range(n))

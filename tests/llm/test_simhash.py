import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash
from pyspark.sql import Row

from docquarry.llm import simhash
from tests.conftest import SF
from tests.llm import fixtures


def brute_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, radius):
    root = {i: i for i in range(len(prints))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(prints)), 2):
        if bin(prints[a] ^ prints[b]).count("1") <= radius:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(i) for i in range(len(prints))]


def check(rows, texts_by_id):
    ids = sorted(texts_by_id)
    prints = [brute_print(texts_by_id[i]) for i in ids]
    roots = brute_components(prints, 2)
    want = {i: (f"{p:016x}", ids[r]) for i, p, r in zip(ids, prints, roots, strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == want


def test_given_documents(spark):
    from docquarry.session import table

    docs = table(spark, SF, "documents")
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    check(rows, {r.doc_id: r.text for r in docs.collect()})


def test_same_hash_as_the_engine(spark):
    assert spark.sql("SELECT xxhash64('a b ü')").first()[0] == np.uint64(xxhash.xxh64_intdigest("a b ü", 42)).astype(np.int64)


def test_odd_rows(spark):
    rows = simhash.near_duplicates(fixtures.odd(spark)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert len(rows) == 11 and len(by[4]) == 2
    assert {by[i][0].fingerprint for i in (1, 2, 3)} == {"0" * 16}
    assert {by[i][0].component_id for i in (1, 2, 3)} == {1}
    assert by[None][0].component_id is None
    kept = simhash.keep_one_of_each(fixtures.odd(spark))
    assert kept.columns == fixtures.odd(spark).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 8, 9]
    repeated = spark.createDataFrame([(3, "gamma"), (4, "alpha"), (4, "gamma"), (None, "alpha"), (None, "beta"), (None, "beta"), (3, "gamma")], "doc_id long, text string")
    assert sorted(map(str, simhash.keep_one_of_each(repeated).collect())) == sorted(map(str, [Row(doc_id=3, text="gamma"), Row(doc_id=4, text="alpha"), Row(doc_id=None, text="beta")]))


def test_empty(spark):
    assert simhash.near_duplicates(fixtures.empty(spark)).collect() == []


@pytest.mark.parametrize("tile_rows", [3, 40, 100_000])
def test_tiles_cut_into_chunks_lose_no_link(spark, tile_rows):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = set(base)
    for b in base:
        for _ in range(25):
            v = b
            for _ in range(rng.randint(1, 5)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values |= {0, 1, (1 << 64) - 1}
    values = sorted(values)
    df = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    links = [(int(np.int64(r.u).astype(np.uint64)), int(np.int64(r.v).astype(np.uint64))) for r in simhash.near_links(df, 2, tile_rows).collect()]
    at = {v: i for i, v in enumerate(values)}
    label = simhash.forest(len(values), np.array([at[u] for u, _ in links]), np.array([at[v] for _, v in links]))
    assert label.tolist() == brute_components(values, 2)
    assert len(links) < 40 * len(values)


def test_one_of_each_with_clashing_names_and_rows_that_repeat(spark):
    rows = [(1, "a b c d", 5), (1, "a b c d", 7), (1, "a b c d", 5), (2, "a b c d", 1), (3, "w x y z", 2), (None, "w x y z", 3), (4, None, 1), (4, None, 1)]
    names = ("__kept", "__h", "__rows", "rows", "row", "id", "h", "fp", "text_hash", "root")
    df = spark.createDataFrame(rows, "doc_id long, text string, extra int").select("*", *[F.lit("x").alias(c) for c in names])
    got = simhash.keep_one_of_each(df)
    assert got.columns == df.columns
    kept = sorted((r.doc_id, r.text) for r in got.collect())
    assert [k[0] for k in kept] == [1, 3, 4] and all(r["__kept"] == "x" for r in got.collect())
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in simhash.keep_one_of_each(df.orderBy(F.desc("extra"))).collect()}

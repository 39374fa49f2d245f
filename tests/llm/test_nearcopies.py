"""Near copies of the pipeline's stage against all pairs compared by their 5-word shingles."""

import random
from itertools import combinations

import numpy as np

import corpus_pipeline
from docquarry.llm import nearcopies, simhash
from docquarry.session import table
from tests.conftest import SF
from tests.llm import fixtures


def shingles(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").split(" ") if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_roots(texts, radius=2):
    """The least index of each text's group, by fingerprints within the radius or Jaccard of 0.8."""
    root, grams, prints = list(range(len(texts))), [shingles(t) for t in texts], [simhash.fingerprint_text(t) for t in texts]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        shared = len(grams[a] & grams[b])
        if bin(prints[a] ^ prints[b]).count("1") <= radius or (shared and shared >= 0.8 * len(grams[a] | grams[b])):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(i) for i in range(len(texts))]


def kept(spark, docs):
    return {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}


def test_given_documents(spark):
    docs = table(spark, SF, "documents")
    texts = dict(sorted((r.doc_id, r.text) for r in docs.collect()))
    ids = list(texts)
    assert kept(spark, docs) == {ids[r] for r in brute_roots(list(texts.values()))}


def test_copies_with_changed_words(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(240)]
        for changed in (0, 1, 2, 3, 12, 40):
            again = list(words)
            for at in rng.sample(range(240), changed):
                again[at] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(again))
    got = kept(spark, fixtures.docs(spark, texts, first=0))
    assert got == set(brute_roots(texts))
    assert len(got) < len(set(brute_components_of_radius(texts)))


def brute_components_of_radius(texts):
    from tests.llm.test_simhash import brute_components

    return brute_components([simhash.fingerprint_text(t) for t in texts], 2)


def test_chain_whose_ends_are_unlike(spark):
    """Members that aren't like the least one of their bucket still meet each other."""
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join([*(f"n{i}" for i in range(at)), *words[at:]]) for at in range(0, 200, 8)]
    grams = [shingles(t) for t in texts]
    assert not grams[0] & grams[-1] == grams[0] and len(grams[0] & grams[-1]) < 0.5 * len(grams[0] | grams[-1])
    assert kept(spark, fixtures.docs(spark, texts, first=0)) == set(brute_roots(texts)) == {0}


def test_links_are_all_near_copies(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[: at] + [f"y{at}"] + words[at + 1 :]) for at in rng.sample(range(60), 30)]
    signed = {int(np.uint64(simhash.fingerprint_text(t)).astype(np.int64)): shingles(t) for t in texts}
    docs = fixtures.docs(spark, texts)
    links = nearcopies.near_copy_links(docs, nearcopies.sketches(docs)).collect()
    assert links and all(len(signed[r.u] & signed[r.v]) >= 0.8 * len(signed[r.u] | signed[r.v]) for r in links)
    none = fixtures.empty(spark)
    assert nearcopies.near_copy_links(none, nearcopies.sketches(none)).collect() == []


def cloud(size, edits, seed):
    """Near copies of one text, each with some words changed for good and some by itself."""
    rng = random.Random(seed)
    texts = [[f"w{rng.randrange(5000)}" for _ in range(150)]]
    while len(texts) < size:
        words = list(rng.choice(texts))
        for _ in range(rng.randrange(1, edits)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(5000)}"
        texts.append(words)
    return [" ".join(words) for words in texts]


def test_large_group_costs_its_size(spark, monkeypatch):
    """A cloud of copies of copies: the groups of all pairs, from a number of candidates that grows with the group."""
    texts = cloud(700, 6, 1) + [" ".join(f"p{i}" for i in range(60)) + " " + " ".join(f"q{n} {i}" for i in range(20)) for n in range(300)]
    seen = []
    verified = nearcopies._verified
    monkeypatch.setattr(nearcopies, "_verified", lambda pairs, sets: seen.append(pairs.count()) or verified(pairs, sets))
    got = kept(spark, fixtures.docs(spark, texts, first=0))
    want = set(brute_roots(texts))
    assert want <= got and len(got - want) <= 0.01 * len(texts), (len(got), len(want))
    assert seen[0] < 20 * len(texts)


def test_forest_of_distances():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 64, (40, 3), dtype=np.uint64)
    words[20:] = words[:20]
    words[20:, 0] ^= np.uint64(1 << 7)
    a, b = nearcopies.candidates(words, 26)
    assert {tuple(sorted(x)) for x in zip(a.tolist(), b.tolist(), strict=True)} == {(i, i + 20) for i in range(20)}
    same = np.repeat(words[:1], 3000, axis=0)
    a, b = nearcopies.candidates(same, 26)
    assert len(np.unique(simhash.forest(3000, a, b))) == 1 and len(a) < 6000

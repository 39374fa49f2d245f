import random
from collections import Counter

from docquarry.llm import decontaminate as D
from docquarry.session import table
from tests.conftest import SF
from tests.llm import fixtures


def make_index(texts):
    items = [(i, *D.split_item(t)) for i, t in enumerate(texts)]
    df, sizes = Counter(), []
    for _, q, a in items:
        words = D.words_of(q) + D.words_of(a)
        df.update(set(words))
        sizes.append(len(words))
    return D.build_index(items, df, len(items), sum(sizes) / len(items), D.stride_of(max(sizes)))


def brute(index, words, threshold):
    """Scores of all items for all passages, without any skipping."""
    out = {}
    for p in range(0, len(words), index.stride // 2):
        score = Counter()
        for t in set(words[p : p + 2 * index.stride]):
            k = index.terms.get(t)
            if k is not None:
                for q in range(index.post_at[k], index.post_at[k + 1]):
                    score[int(index.post_item[q])] += float(index.post_impact[q])
        out |= {(i, p): s for i, s in score.items() if s >= threshold}
    return out


def test_wand_finds_all_that_scoring_everything_finds(monkeypatch):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(120)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(3, 40))) for _ in range(57)]
    index = make_index(texts)
    for cells in (D.DENSE_CELLS, 0):
        monkeypatch.setattr(D, "DENSE_CELLS", cells)
        for _ in range(60):
            words = rng.choices(vocab + ["x"] * 60, k=rng.randint(0, 400))
            if rng.random() < 0.5:
                words[10:10] = texts[rng.randrange(57)].split()
            for threshold in (0.4, 0.7):
                got = {(i, p): s for i, s, p in D.passages_of(index, words, threshold)}
                want = brute(index, words, threshold)
                assert got.keys() == want.keys()
                assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_given_tables(spark):
    docs, items = table(spark, SF, "documents"), D.items_of(table(spark, SF, "benchmark"))
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect()}
    plain = lambda t: f" {' '.join(D.words_of(t))} "
    bench = [(r.item_id, plain(r.text)) for r in table(spark, SF, "benchmark").collect()]
    rows = [(r.doc_id, plain(r.text)) for r in docs.collect()]
    assert got == {(d, i) for d, text in rows for i, item in bench if item in text}
    left = {r.doc_id for r in D.keep_uncontaminated(docs, items).collect()}
    assert left == {d for d, _ in rows} - {d for d, _ in got}


def test_answer_must_stand_too(spark):
    items = spark.createDataFrame([(1, "what is the tallest mountain that climbers know on this earth", "everest himalaya nepal")], "item_id long, question string, answer string")
    texts = ["filler " * 90 + "what is the tallest mountain that climbers know on this earth everest himalaya nepal", "what is the tallest mountain that climbers know on this earth", None, "", "everest himalaya nepal"]
    got = D.contaminated(fixtures.docs(spark, texts), items).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 1)]


def test_scattered_words_are_no_match_whatever_else_is_tested(spark):
    """Passages and windows go by an item's own length, not by the longest item's."""
    item = (1, "what is the capital of france", "paris")
    scattered = " ".join(w + " filler" * 150 for w in "what is the capital of france paris".split())
    texts = [scattered, "so what is the capital of france then paris", " ".join("what is the capital of france paris".split()[::-1])]
    long = (2, " ".join(f"l{i}" for i in range(650)), " ".join(f"m{i}" for i in range(50)))
    for items in ([item], [item, long]):
        df = spark.createDataFrame(items, "item_id long, question string, answer string")
        assert {(r.doc_id, r.item_id) for r in D.contaminated(fixtures.docs(spark, texts), df).collect()} == {(2, 1), (3, 1)}
    whole = fixtures.docs(spark, ["x " * 333 + f"{long[1]} {long[2]}" + " y" * 500])
    assert [(r.item_id, r.first_word) for r in D.contaminated(whole, df).collect()] == [(2, 333)]


def test_window_equals_trying_all():
    rng = random.Random(8)
    for _ in range(300):
        question, answer = Counter(rng.choices("abcdef", k=rng.randrange(0, 6))), Counter(rng.choices("efgh", k=rng.randrange(0, 4)))
        words = rng.choices("abcdefghxyz", k=rng.randrange(0, 40))
        span = (3 * (question.total() + answer.total()) + 1) // 2
        tried = []
        for at in range(len(words)):
            if words[at] in question or words[at] in answer:
                bag = Counter(words[at : at + span])
                q, a = (sum(min(n, bag[w]) for w, n in side.items()) for side in (question, answer))
                shares = q / question.total() if question else 1.0, a / answer.total() if answer else 1.0
                if min(shares) >= 0.8:
                    tried.append((q + a, -at, *shares))
        want = max(tried, default=None)
        got = D.best_window(words, question, answer, 0.8)
        assert got == (want and (want[0], -want[1], *want[2:]))


def test_index_groups_are_bounded(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"question {i} a b c d e f", f"answer {i}") for i in range(50)], "item_id long, question string, answer string")
    monkeypatch.setattr(D, "SHARD_ITEMS", 5)
    monkeypatch.setattr(D, "INDEX_BYTES", 1)
    groups = list(D.index_groups(items))
    assert len(groups) > 5 and all(len(g) == 1 for g in groups) and sorted(i for g in groups for i in g[0].ids) == list(range(50))
    got = D.contaminated(fixtures.docs(spark, ["question 7 a b c d e f answer 7", "no"]), items).collect()
    assert (1, 7) in {(r.doc_id, r.item_id) for r in got} and {r.doc_id for r in got} == {1}


def test_odd_rows_and_shards(spark, monkeypatch):
    texts = ["alpha beta gamma delta epsilon. zeta eta", "one two three four five six. seven eight"]
    items = D.items_of(spark.createDataFrame([(1, texts[0]), (2, texts[1]), (3, None), (None, "x y"), (2, texts[1])], "item_id long, text string"))
    monkeypatch.setattr(D, "SHARD_ITEMS", 1)
    got = D.contaminated(fixtures.docs(spark, [f"pre {t} post" for t in texts] + [texts[0]]), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (2, 2), (3, 1)]
    assert D.contaminated(fixtures.odd(spark), items).collect() == []
    assert D.contaminated(fixtures.empty(spark), items).collect() == []
    nothing = items.limit(0)
    assert D.contaminated(fixtures.odd(spark), nothing).collect() == []
    assert D.keep_uncontaminated(fixtures.odd(spark), nothing).count() == 11


def test_a_match_is_found_wherever_it_stands():
    """Items of any length, their words spread over one and a half times that, at every offset of a passage."""
    rng = random.Random(9)
    for n, span in ((64, 96), (64, 89), (60, 90), (128, 192), (40, 60)):
        words = [f"i{k}" for k in range(n)]
        index = make_index([" ".join(words)])
        places = sorted(rng.sample(range(1, span - 1), n - 2))
        spread = [f"x{k}" for k in range(span)]
        for at, w in zip([0, *places, span - 1], words, strict=True):
            spread[at] = w
        for offset in range(2 * index.stride):
            text = ["y"] * offset + spread + ["z"] * 40
            assert [m[0] for m in D.matches(index, text)] == [0], (n, span, offset)

"""Learned operators: held-out accuracy, and defined results for odd rows."""

import math
import random
import zlib

import numpy as np
import pytest

from docquarry.llm import langid, toxicity
from docquarry.session import table
from tests.llm import fixtures

SF = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"  # enough held-out labels for rates


def auc(scores, labels):
    ranks = np.argsort(np.argsort(scores)) + 1
    pos = labels > 0
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_toxicity_on_held_out_rows(spark):
    docs, labels = table(spark, LARGER, "documents", spread=True), table(spark, LARGER, "labels")
    got = toxicity.toxicity(docs, labels).toPandas()
    assert len(got) == docs.count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    joined = got.merge(labels.toPandas(), on="doc_id")
    held = joined[joined.held_out]
    assert auc(held.score.to_numpy(), held.toxic.to_numpy()) > 0.95
    assert held[held.toxic == 0].predicted.mean() < 0.01
    assert held[held.toxic == 1].predicted.mean() > 0.8


def test_toxicity_odd_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    weights = toxicity.train(docs, labels)
    rows = toxicity.score(fixtures.odd(spark), weights).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.toxicity(fixtures.empty(spark), labels).collect() == []
    none = toxicity.toxicity(fixtures.docs(spark, ["a b"]), labels.limit(0)).collect()
    assert [(round(r.score, 9), r.predicted) for r in none] == [(0.25, 0)]
    kept = toxicity.keep_clean(fixtures.odd(spark), labels.limit(0))
    assert kept.count() == 11 and kept.columns == fixtures.odd(spark).columns


def test_ftrl_learns_and_is_sparse():
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(600):
        x = rng.choice(5000, 60, replace=False) + 10
        y = float(i % 5 == 0)
        rows.append(np.append(x, 3) if y else x)
        labels.append(y)
    f, w, bias = toxicity.ftrl(rows, np.array(labels))
    table_ = np.zeros(6000)
    table_[f] = w
    scores = np.array([table_[x].sum() + bias for x in rows])
    assert auc(scores, np.array(labels)) > 0.99
    assert 3 in f and len(f) < 500


def plain_ftrl(rows, labels, alpha=1.0, beta=1.0, l1=4.0, l2=1.0, epochs=3):
    """The same learner a coordinate at a time, as published; the bias has neither penalty."""
    z, n = {}, {}
    weight = lambda i: 0.0 if i != "bias" and abs(z.get(i, 0.0)) <= l1 else -(z.get(i, 0.0) - (0 if i == "bias" else math.copysign(l1, z[i]))) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + (0 if i == "bias" else l2))
    for _ in range(epochs):
        for x, y in zip(rows, labels, strict=True):
            w = {i: weight(i) for i in [*x, "bias"]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i, wi in w.items():
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * wi
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if i == "bias" or weight(i)}


def test_ftrl_equals_the_plain_learner():
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 300, 40)) for _ in range(200)]
    labels = np.array([float(5 in r or 9 in r) for r in rows])
    f, w, bias = toxicity.ftrl(rows, labels)
    want = plain_ftrl([r.tolist() for r in rows], labels)
    assert bias == pytest.approx(want.pop("bias")) and dict(zip(f.tolist(), w, strict=True)) == pytest.approx(want)


def test_scores_equal_plain_sums(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    f, w, bias = toxicity.train(docs, labels)
    weights = dict(zip(f.tolist(), w, strict=True))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.score(docs, (f, w, bias)).collect():
        assert r.score == pytest.approx(1 / (1 + math.exp(-bias - sum(weights.get(i, 0.0) for i in toxicity.features(texts[r.doc_id]).tolist()))), abs=1e-5)


def test_repeated_ids_are_one_example(spark):
    texts = [(i, f"kind words {i}" if i % 2 else f"vile words {i}") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2 == 0) for i in range(60)], "doc_id long, toxic boolean").selectExpr("doc_id", "cast(toxic as int) AS toxic")
    once = toxicity.train(spark.createDataFrame(texts, "doc_id long, text string"), labels)
    again = toxicity.train(spark.createDataFrame(texts * 5 + [(None, "x")], "doc_id long, text string"), labels.union(labels))
    assert all(np.array_equal(a, b) for a, b in zip(once, again, strict=True)) and len(once[0])


def plain_language(model, text):
    """Loss-weighted decoding an n-gram at a time."""
    grams = [int(g) for w in langid._words((text or "").lower()) for g in langid.word_grams([w])[0]]
    if not grams:
        return "und"
    bits = [sum(float(model.weights[g, b]) for g in grams) / len(grams) for b in range(model.codes.shape[1])]
    loss = [sum(r * math.log1p(math.exp(-c * b * 4)) for c, b, r in zip(code, bits, model.reliability, strict=True)) for code in model.codes.tolist()]
    return model.languages[min(range(len(loss)), key=loss.__getitem__)]


def test_language_equals_plain_decoding(spark):
    docs = table(spark, SF, "documents").limit(150)
    model = langid.train(docs)
    texts = {r.doc_id: (r.text, r.lang) for r in docs.collect()}
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    assert got == {i: plain_language(model, t) for i, (t, _) in texts.items()}
    # and each bit's weights are the log ratio of the two sides' mean rates
    counts = {k: np.zeros(1 << langid.DIM_BITS) for k in model.languages}
    for text in {(lang, t) for i, (t, lang) in texts.items() if zlib.crc32(str(i).encode()) % 3 != 1}:
        for w in langid._words(text[1].lower()):
            np.add.at(counts[text[0]], langid.word_grams([w])[0], 1)
    rates = np.array([counts[k] / counts[k].sum() for k in model.languages])
    for b, code in enumerate(model.codes.T):
        want = np.log((rates[code > 0].mean(axis=0) + 1e-6) / (rates[code < 0].mean(axis=0) + 1e-6))
        assert np.allclose(model.weights[:, b], want, atol=1e-3)


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([(1, "some words", None), (2, "12", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in langid.keep_identified(none).collect()] == [1]
    assert {(r.lang_pred, r.score) for r in langid.identify(none).collect()} == {("und", 0.0)}


def test_hundreds_of_languages_and_repeated_ids(spark):
    rng = random.Random(2)
    letters = {k: rng.sample("abcdefghijklmnopqrstuvwxyz", 8) for k in range(300)}
    rows = [(i if i % 9 else None, " ".join("".join(rng.choices(letters[k], k=5)) for _ in range(60)), f"l{k:03}") for i, k in enumerate(list(range(300)) * 4)]
    got = langid.identify(spark.createDataFrame(rows * 2, "doc_id long, text string, lang string")).toPandas()
    assert len(got) == 2400 and got.lang_pred.nunique() > 250


def test_language_on_held_out_rows(spark):
    docs = table(spark, SF, "documents")
    got = langid.identify(docs).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    held = got[got.held_out].merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (held.lang == held.lang_pred).mean() > 0.99


def test_language_odd_rows(spark):
    rows = {r.doc_id: r for r in langid.identify(fixtures.odd(spark)).collect()}
    assert {r.lang_pred for r in rows.values()} == {"und"}
    texts = ["the cat and the dog"] * 9 + ["der hund und die katze"] * 9 + [None, "", "12 ##"]
    df = spark.createDataFrame([(i, t, "en" if i < 9 else "de" if i < 18 else None, 0.1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert [got[i].lang_pred for i in (0, 10, 18, 19, 20)] == ["en", "de", "und", "und", "und"]
    kept = langid.keep_identified(df)
    assert kept.count() == 18 and kept.columns == df.columns
    assert langid.identify(fixtures.empty(spark)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 12, 40])
def test_codewords_differ_in_many_bits(n):
    m = langid.codewords(n)
    assert len(m) == n and set(np.unique(m)) <= {-1, 1}
    if n > 2:
        apart = [(m[i] != m[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= (2 ** (n - 2) if n <= 7 else 5)


def test_long_examples_are_learned_from_whole(spark):
    """20,000 words make over 100,000 features; each of them moves the weights, wherever its number lies."""
    words = [f"{i:05d}{i:05d}" for i in range(20_000)]
    docs = spark.createDataFrame([(i, " ".join(words) if i % 2 else "plain") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    f, w, bias = toxicity.train(docs, labels)
    numbers = toxicity.features(" ".join(words))
    assert len(numbers) > 100_000
    learned = np.isin(f, numbers)
    assert learned.sum() > 50_000 and f[learned].max() > numbers[int(0.99 * len(numbers))]


def test_copies_push_no_text_out_of_the_sample(spark):
    from docquarry.llm import langid

    german = ["das ist ein deutscher satz", "wir gehen heute in den garten", "der hund schläft unter dem baum", *(f"ein anderer satz über dinge und leute nummer {chr(97 + i)}" for i in range(17))]
    english = [f"this is an english sentence about things and people number {chr(97 + i)}" for i in range(26)]
    rows = [*(("guten tag welt", "de") for _ in range(4_000)), *((t, "de") for t in german for _ in range(2)), *((t, "en") for t in english for _ in range(40))]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.train(docs, per_language=200)
    classify = langid.Classifier(model)
    assert [classify(t)[0] for t in (*german, "guten tag welt", english[0])] == ["de"] * (len(german) + 1) + ["en"]

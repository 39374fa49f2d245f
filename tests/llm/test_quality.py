from collections import Counter

from docquarry.llm import quality
from tests.llm import fixtures


def brute(text):
    text = text or ""
    words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = {g for g, n in Counter(grams).items() if n > 1}
    hit = {p for i, g in enumerate(grams) if g in many for p in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def test_odd_and_repeating_texts(spark):
    line = "the quick brown fox jumps over the lazy dog and runs away"
    texts = [line, "\n".join([line] * 9), line + " x " + line, " ".join(str(i) for i in range(400)), "a b c d e f g h a b c d e f g h", "# * $ | <> 🙂\x0b\x0c x", f"{line}\n \n{line}\nother", None]
    df = fixtures.docs(spark, texts).unionByName(fixtures.odd(spark))
    every = {r.doc_id: r for r in quality.apply_rules(fixtures.docs(spark, texts)).collect()}
    got = lambda r: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
    assert {i: got(r) for i, r in every.items()} == {i: brute(t) for i, t in enumerate(texts, 1)}
    odd = quality.apply_rules(fixtures.odd(spark)).collect()
    assert len(odd) == 11 and all(got(r) == brute(r.text) for r in odd)
    assert not any(r.kept for r in odd if r.base_failed)
    assert quality.apply_rules(df.limit(0)).collect() == []


def test_wide_path_is_the_same(spark, monkeypatch):
    texts = ["a b c d e f g h i a b c d e f g h z", "x " * 40]
    want = [r.n_repeat_words for r in quality.apply_rules(fixtures.docs(spark, texts)).orderBy("doc_id").collect()]
    monkeypatch.setattr(quality, "PLACE_BITS", 3)
    assert [r.n_repeat_words for r in quality.apply_rules(fixtures.docs(spark, texts)).orderBy("doc_id").collect()] == want == [brute(t)[4] for t in texts]


def test_plan_has_no_python_and_no_shuffle(spark):
    plan = quality.apply_rules(fixtures.docs(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_other_rules(spark):
    kept = quality.apply_rules(fixtures.docs(spark, ["word " + " ".join(f"w{i}" for i in range(30))]), rules=(("n_words", 100, None),)).first().kept
    assert kept is False


def test_columns_named_like_steps_are_kept(spark):
    df = spark.createDataFrame([(1, "some words " * 20, "mine", 7)], "doc_id long, text string, `__words` string, `__packed` int")
    got = quality.apply_rules(df).first()
    assert (got["__words"], got["__packed"], got["n_words"]) == ("mine", 7, 40)
    assert quality.apply_rules(df).columns[:4] == df.columns

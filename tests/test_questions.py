"""Question search against a plain reading of the same rules."""

import random
import re

import pytest

from docquarry.operators import questions as Q
from docquarry.operators import retrieval as R

CHUNK = "document_id long, ordinal int, filename string, status string, header string, section string, content string, tags map<string,string>, embedding array<float>"


def test_questions_are_read_like_a_web_search():
    must = lambda q: [(x.must, x.must_not) for x in Q.parse(q)]
    assert must("What is the escalation policy?") == [([("escalation",), ("polic",)], [])]
    assert must('"priority incidents" -draft or INC0042317') == [([("priorit", "incident")], [("draft",)]), ([("inc0042317",)], [])]
    assert must('fly-out -"old rules"') == [([("fly", "out")], [("old", "rul")])] or must("fly-out")[0][0] == [("fly",)]
    assert must("the of and") == must("") == must("-only") == must("or or") == []
    assert must("a -b") == []


@pytest.mark.parametrize("term, stem", [("policies", "polic"), ("policy", "polic"), ("mailboxes", "mailbox"), ("mailbox", "mailbox"), ("migrations", "migration"), ("failed", "fail"), ("need", "need"), ("the", "the"), ("rules", "rul"), ("rule", "rul"), ("inc0042317", "inc0042317")])
def test_stems(spark, term, stem):
    from pyspark.sql import functions as F

    assert Q.stem_of(term) == stem == spark.range(1).select(Q.stem(F.lit(term))).first()[0]


def plain_score(header, body, question):
    """Covers found by trying every pair of ends."""
    cut = lambda t: [Q.stem_of(w) for w in re.split(r"[^\w]+", t.lower()) if w]
    head, tail = cut(header), cut(body)
    at = [(i - len(head), w, R.HEADER_WEIGHT) for i, w in enumerate(head)] + [(i + 1, w, R.BODY_WEIGHT) for i, w in enumerate(tail)]
    place = {i: (w, x) for i, w, x in at}
    begins = lambda lit: [(i, i + len(lit) - 1, place[i][1]) for i in place if all(place.get(i + k, ("",))[0] == s for k, s in enumerate(lit)) and (i > 0 or i + len(lit) - 1 < 0)]
    total, hit = 0.0, False
    for want in Q.parse(question):
        found = [begins(x) for x in want.must]
        if any(not f for f in found) or any(begins(x) for x in want.must_not):
            continue
        hit = True
        ends = {}
        for hi in sorted({h for f in found for _, h, _ in f}):
            last = [max((x for x in f if x[1] <= hi), default=None, key=lambda x: x[1]) for f in found]
            if None in last:
                continue
            lo, weight = min(x[0] for x in last), len(last) / sum(1 / x[2] for x in last)
            ends.setdefault(lo, (hi, weight))
        total += sum(w / (1 + max(0, hi - lo + 1 - sum(map(len, want.must)))) for lo, (hi, w) in ends.items())
    return total if hit else None


@pytest.mark.parametrize("question", ["alpha beta", '"alpha beta" gamma', "alpha or betas delta", "gamma -delta", '"gamma gamma"', 'alpha -"beta gamma" or delta', "epsilon"])
def test_scores_equal_trying_all_spans(spark, question):
    rng = random.Random(len(question))
    words = ["alpha", "beta", "betas", "gamma", "delta", "x", "y"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(4))), " ".join(rng.choices(words, k=rng.randrange(14)))) for i in range(80)]
    df = spark.createDataFrame(rows, "document_id long, header string, content string")
    got = {r.document_id: r.text_score for r in Q.question_scores(df, question, ("document_id",)).collect()}
    want = {i: s for i, h, b in rows if (s := plain_score(h, b, question)) is not None}
    assert got == pytest.approx(want) and (want or question == "epsilon")


def chunk(doc, ordinal, text, x, status="ready", **tags):
    return doc, ordinal, f"{doc}.md", status, None, None, text, tags, [float(x), 1.0]


def ids(df):
    return [(r.document_id, r.ordinal) for r in sorted(df.collect(), key=lambda r: (-r.score, r.ordinal, r.document_id))]


def test_chunks_found_by_both_halves_come_first(spark):
    rows = [chunk(1, 0, "quarterly escalation policy for priority incidents", 0.5), chunk(1, 1, "unrelated wording entirely", 0.51), chunk(1, 2, "quarterly escalation policy", 9), chunk(2, 0, "quarterly escalation policy", 0.5, "pending")]
    got = Q.search_chunks(spark.createDataFrame(rows, CHUNK), "quarterly escalation policy", [0.5, 1.0], 10)
    assert ids(got)[0] == (1, 0) and len(ids(got)) == 3
    top = {(r.document_id, r.ordinal): r for r in got.collect()}
    assert top[1, 0].vec_rank == 1 and top[1, 0].text_rank is not None and top[1, 1].text_rank is None


def test_codes_tags_ties_and_nothing(spark):
    rows = [chunk(1, 0, "Incident code INC0042317 covers mailbox migration failures", 9), chunk(1, 1, "General guidance about mailboxes and migrations", 0.1), chunk(3, 1, "same words", 5, kind="a"), chunk(2, 1, "same words", 5, kind="b"), chunk(2, 0, "same words", 5, kind="b")]
    df = spark.createDataFrame(rows, CHUNK)
    assert ids(Q.search_chunks(df, "INC0042317", None)) == [(1, 0)]
    assert ids(Q.search_chunks(df, "same word", None)) == [(2, 0), (2, 1), (3, 1)]
    assert ids(Q.search_chunks(df, "same words", None, where=df.tags["kind"] == "a")) == [(3, 1)]
    assert len(ids(Q.search_chunks(df, "the of", [1.0, 0.0], 2))) == 2
    assert ids(Q.search_chunks(df.limit(0), "anything", [1.0, 0.0])) == []


def test_phrases_alone_are_ranked_and_terms_are_literal(spark):
    df = spark.createDataFrame([(1, "", "red car"), (2, "", "red car, red car red car"), (3, "", "car red"), (4, "", r"a \E b")], "document_id long, header string, content string")
    got = R.text_pool(df, (), 5, phrases=("red car",)).collect()
    assert [(r.document_id, round(r.text_score, 6)) for r in sorted(got, key=lambda r: r.text_rank)] == [(2, 1.2), (1, 0.4)]
    assert R.text_scores(df, ("a\\E",)).count() == 0

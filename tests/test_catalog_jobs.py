"""Catalogue, retrieval and job rules on small tables."""

import pytest
from pyspark.sql import functions as F

from docquarry.functions.text import slug_ok
from docquarry.operators import catalog as C
from docquarry.operators import enrich as E
from docquarry.operators import jobs as J
from docquarry.operators import retrieval as R


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_upsert_is_idempotent(spark):
    have = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    once = C.upsert(have, new, "k")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, C.upsert(once, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_delete_counts_both_sides(spark):
    rows = spark.createDataFrame([(1,), (5,), (None,)], "x long")
    kept, gone = C.delete_where(rows, F.col("x") > 3)
    assert (kept.count(), gone.count()) == (2, 1)


@pytest.mark.parametrize(("label", "after"), [("v1", "v2"), ("v41", "v42"), ("draft", "v2"), ("", "v2"), ("V3", "v2")])
def test_next_version(spark, label, after):
    assert one(spark, C.next_version(F.lit(label))) == after


@pytest.mark.parametrize(("slug", "ok"), [("a-b", True), (" Team-9 ", True), ("a--b", False), ("-a", False), ("a_b", False), ("", False)])
def test_slugs(spark, slug, ok):
    assert one(spark, slug_ok(F.lit(slug))) is ok


def test_versions_and_duplicates(spark):
    docs = spark.createDataFrame([("w", 1, "f", "x", "ready"), ("w", 2, "f", "x", "ready"), ("w", 3, "f", "y", "failed"), ("w", 4, "g", "y", "ready"), ("v", 5, "f", "x", "ready"), ("w", 6, "f", "x", "ready")], "workspace_id string, document_id long, filename string, content string, status string")
    got = {r.document_id: (r.version, r.superseded) for r in C.version_chain(docs).collect()}
    assert got == {1: ("v1", True), 2: ("v1", True), 3: ("v2", True), 6: ("v3", False), 4: ("v1", False), 5: ("v1", False)}
    dup = {r.document_id: r.duplicate for r in C.exact_duplicates(docs).collect()}
    assert dup == {1: False, 2: True, 3: False, 4: False, 5: False, 6: True}


def test_spellings(spark):
    values = F.array(*[F.lit(x) for x in (" Ab", "ab", "", "C", "aB ", "d")])
    assert one(spark, C.distinct_spellings(values)) == ["Ab", "C", "d"]
    assert len(one(spark, C.distinct_spellings(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: i.cast("string"))))) == 12


@pytest.mark.parametrize(("text", "kind"), [("Hi!", "greeting"), ("  good   MORNING. ", "greeting"), ("thank you so much!!", "thanks"), ("ok", "ack"), ("see ya", "farewell"), ("What is this?", "meta"), ("hi, how do I escalate?", None), ("", None), ("this", None)])
def test_small_talk(spark, text, kind):
    assert one(spark, R.message_kind(F.lit(text))) == kind


def test_citations_in_order_of_use(spark):
    rows = spark.createDataFrame([(1, "a [3] b [1][3] [9] [100] [0] [2]", 3), (2, None, 3), (3, "none", 0)], "id long, answer string, n int")
    assert [(r.id, r.rank, r.number) for r in R.citations(rows, "answer", "n", ["id"]).orderBy("id", "rank").collect()] == [(1, 0, 3), (1, 1, 1), (1, 2, 2)]


def test_distances(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0]), (7, [3.0, 0.0])], "document_id long, embedding array<float>")
    got = {r.document_id: r.distance for r in R.cosine_distances(rows, [2.0, 0.0]).collect()}
    assert got[1] == got[7] == pytest.approx(0) and got[2] == pytest.approx(1) and got[3] == pytest.approx(2)
    assert got[4] is got[5] is got[6] is None
    assert [(r.document_id, r.vec_rank) for r in R.vector_pool(rows, [2.0, 0.0], 3).orderBy("vec_rank").collect()] == [(1, 1), (7, 2), (2, 3)]


def docs(spark):
    rows = [(1, "w", "a.md", "red apples grow", "ready", "a.md > x"), (2, "w", "b.md", "red pears", "ready", "b.md > x"), (3, "v", "c.md", "red apples", "ready", "c.md > x"), (4, "w", "apples.md", "red", "failed", "apples.md > x"), (5, "w", "d.md", "code QX-77 in red", "ready", "d.md > red")]
    return spark.createDataFrame(rows, "document_id long, workspace_id string, filename string, content string, status string, header string")


def test_hybrid_search_rules(spark):
    vectors = spark.createDataFrame([(i, [float(i == 2), 1.0], i % 2) for i in range(1, 7)], "document_id long, embedding array<float>, tag int")
    got = R.hybrid_search(docs(spark), vectors, [1.0, 0.0], ["red"], 8, F.col("workspace_id") == "w").collect()
    assert {r.document_id for r in got} == {1, 2, 5}
    best = max(got, key=lambda r: r.score)
    assert best.document_id == 2 and best.score == pytest.approx(round(1 / 61 + 1 / (60 + best.text_rank), 5))
    tagged = R.hybrid_search(docs(spark), vectors, [1.0, 0.0], ["red"], 8, None, F.col("tag") == 1).collect()
    assert {r.document_id for r in tagged} == {1, 3, 5}
    text = R.hybrid_search(docs(spark), vectors, None, ["qx", "77"], 8).collect()
    assert [r.document_id for r in text] == [5] and text[0].vec_rank is None


def test_terms_phrases_and_exclusion(spark):
    ids = lambda *a, **k: sorted(r.document_id for r in R.text_scores(docs(spark), *a, **k).collect())
    assert ids(["red", "apples"]) == [1, 3, 4]
    assert ids(["red"], must_not=["apples"]) == [2, 5]
    assert ids([], phrases=["red apples"]) == [1, 3]
    scores = {r.document_id: r.text_score for r in R.text_scores(docs(spark), ["red"]).collect()}
    assert scores[5] == pytest.approx(1.4) and scores[1] == pytest.approx(0.4)


def test_headers_and_json(spark):
    assert one(spark, E.context_header(F.lit("d"), F.array(F.lit("a"), F.lit(" ")), F.lit(""))) == "d > a"
    assert one(spark, E.context_header(F.lit("d"), F.lit(None).cast("array<string>"), F.lit(" x "))) == "d - x"
    for raw, k in (('```json\n{"k": 3}\n```', 3), ('so: {"k": 4} ok', 4), ("{broken", None), ("", None)):
        found = one(spark, R.lenient_object(F.lit(raw), "k long"))
        assert (found.k if found else None) == k


def test_retry_rules(spark):
    assert one(spark, J.server_delay(F.lit("Please retry in 53.57s"))) == 53.57
    assert one(spark, J.server_delay(F.lit("{'retryDelay': '99s'}"))) == 65.0
    assert one(spark, J.server_delay(F.lit("quota"))) is None
    assert one(spark, J.retryable(F.lit(503), F.lit(None).cast("string"))) is True
    assert one(spark, J.retryable(F.lit(403), F.lit("quota project"))) is False
    assert one(spark, J.retryable(F.lit(None).cast("int"), F.lit("Connection RESET"))) is True


@pytest.mark.parametrize(("done", "total", "pct"), [(0, 10, 50), (5, 10, 75), (10, 10, 100), (0, 0, 100), (1, 3, 66)])
def test_progress(spark, done, total, pct):
    assert one(spark, J.progress(F.lit(done), F.lit(total))) == pct


def test_stalled_jobs(spark):
    log = spark.createDataFrame([(1, "2024-01-01 00:00:00", "view", 1), (2, "2024-01-01 05:00:00", "view", 2), (3, "2024-01-01 00:00:00", "error", 3), (3, "2024-01-01 00:00:01", "error", 4), (3, "2024-01-01 00:00:02", "error", 5), (4, "2024-01-01 00:00:00", "signup", 6)], "job_id long, t string, event string, event_id long").withColumn("ts", F.col("t").cast("timestamp"))
    states = J.job_states(log)
    assert {r.job_id: r.status for r in states.collect()} == {1: "running", 2: "running", 3: "failed", 4: "pending"}
    assert [(r.job_id, r.next_status) for r in J.stalled(states, F.lit("2024-01-01 05:30:00").cast("timestamp")).collect()] == [(1, "pending")]
    assert [r.job_id for r in J.claim_order(states, 5).collect()] == [4]

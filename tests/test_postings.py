"""The positional index against a plain reading of texts, and what a question reads of it."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docquarry.functions.stemmer import english
from docquarry.operators import postings as P
from docquarry.operators import questions as Q
from docquarry.plans import indexed, model
from docquarry.session import scratch_folder
from tests.conftest import SF
from tests.test_questions import plain_score

ROWS = "document_id long, status string, header string, content string"
QUESTIONS = ["alpha beta", '"alpha beta" gamma', "alpha or betas delta", "gamma -delta", '"gamma gamma"', 'alpha -"beta gamma" or delta', "epsilon", "alpha or epsilon", "the of", '"x y" or "y x"', "alpha alpha"]


@pytest.mark.parametrize("values", [[], [0], [1, 127, 128, 16_383, 16_384, (1 << 56) - 1], list(range(3_000))])
def test_bytes_give_the_numbers_back(values):
    data, ends = P.written(np.array(values, np.int64))
    assert P.read(data.tobytes()).tolist() == values and len(ends) == len(values)
    x = np.array([-3, -1, 0, 1, 7])
    assert P._unfolded(P._folded(x)).tolist() == x.tolist()


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "beta", "betas", "gamma", "delta", "x", "y", "Été"]
    rows = [(i, rng.choice(["ready", "failed"]), " ".join(rng.choices(words, k=rng.randrange(4))), " ".join(rng.choices(words, k=rng.randrange(14)))) for i in range(n)]
    return [*rows, (n, "ready", None, None), (n + 1, "ready", "", "?!"), (n + 2, None, "alpha", None), (n + 3, "ready", None, "beta " * 3_000 + "alpha"), (n + 4, "ready", "y", "x")]


def built(spark, rows):
    path = scratch_folder(spark, "postings-test")
    P.build(spark.createDataFrame(rows, ROWS).repartition(3), path, ("document_id",), ("status",))
    return path


def pool(spark, path, question, k, **how):
    return P.question_pool(spark.createDataFrame([], ROWS), path, question, k, ("document_id",), ("status",), **how)


def rows_of(spark, path, stem):
    return P.opened(spark, path, [stem], "array<struct<document_id:bigint,status:string>>").where("slot >= 0")


def ranked(rows, question, k):
    found = [(-round(s, 9), i) for i, _, h, b in rows if (s := plain_score(h or "", b or "", question)) is not None]
    return [(i, -s, n) for n, (s, i) in enumerate(sorted(found)[:k], 1)]


@pytest.mark.parametrize("batch_rows", [1_024, 5])
def test_equals_reading_every_text(spark, monkeypatch, batch_rows):
    monkeypatch.setattr(P, "BATCH_ROWS", batch_rows)
    rows = corpus(150)
    path = built(spark, rows)
    for question in QUESTIONS:
        for k in (5, 1_000):
            got = [(r.document_id, r.text_score, r.text_rank) for r in pool(spark, path, question, k).orderBy("text_rank").collect()]
            want = ranked(rows, question, k)
            assert [(i, n) for i, _, n in got] == [(i, n) for i, _, n in want], question
            assert np.allclose([s for _, s, _ in got], [s for _, s, _ in want])
    some = pool(spark, path, "alpha", 1_000, where=lambda r: r["status"] == "ready").collect()
    assert {r.document_id for r in some} == {i for i, _, _ in ranked([r for r in rows if r[1] == "ready"], "alpha", 1_000)}


def test_a_question_reads_its_stems_and_no_text(spark, monkeypatch):
    monkeypatch.setattr(P, "BATCH_ROWS", 40)
    path = built(spark, corpus(400))
    found = pool(spark, path, "alpha gamma", 5)
    assert all(path.split("/")[-1] in f for f in found.inputFiles())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN", plan) and re.search(r"PushedFilters: \[[^\]]*In\(slot", plan)
    read = rows_of(spark, path, "alpha")
    assert len({r[0].rsplit("/", 2)[-2] for r in read.select(F.input_file_name()).collect()}) == 1
    assert all("alpha" in r.stems.split("\n") for r in read.collect())
    assert read.count() >= 9  # a stem that is everywhere has a segment a batch


def test_many_bytes_of_a_bucket_are_several_files(spark, monkeypatch):
    monkeypatch.setattr(P, "BATCH_ROWS", 10)
    monkeypatch.setattr(P, "BUCKETS", 1)
    rows = corpus(200)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small files would be written together
    try:
        path = built(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert rows_of(spark, path, "alpha").select(F.input_file_name()).distinct().count() > 1
    assert [r.document_id for r in pool(spark, path, "alpha beta", 9).orderBy("text_rank").collect()] == [i for i, _, _ in ranked(rows, "alpha beta", 9)]


def test_batches_under_the_kth_score_are_passed_over(spark, monkeypatch):
    rows = [(i, "ready", "alpha" if i < 5 else "", "alpha") for i in range(400)]
    held = [dict(zip(("slot", *P.ROW), row, strict=True)) for row in P.invert([r[2] for r in rows], [r[3] for r in rows], P.Stems(Q.stem_of))]
    want = Q.parse("alpha")[0]
    batch = P._Batch(held, {"alpha"})
    assert batch.bound(want) == 2.0 >= max(batch.scores(want).values()) == 1.4
    assert P._Batch([], {"alpha"}).bound(want) == 0.0


def peak(work) -> int:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_inverting_holds_few_bytes_a_word():
    rng = random.Random(3)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(500)], k=400)) for _ in range(1_000)]
    used = peak(lambda: [None for _ in P.invert([None] * len(texts), texts, P.Stems(Q.stem_of))])
    assert used < 80 * 400_000, used


def test_numbers_are_written_by_slices(monkeypatch):
    values = np.array([random.Random(1).randrange(1 << 40) >> i % 40 for i in range(1_000)])
    whole = P.written(values)
    monkeypatch.setattr(P, "SLICE", 7)
    assert all((a == b).all() for a, b in zip(whole, P.written(values), strict=True)) and P.read(whole[0].tobytes()).tolist() == values.tolist()


def test_a_search_makes_the_keys_of_hits_only():
    """Sixty batches of 4,096 passages in one Arrow batch, of which two passages answer."""
    held = [dict(zip(("slot", *P.ROW), row, strict=True)) for row in P.invert([None] * 4_096, ["beta"] * 4_094 + ["alpha"] * 2, P.Stems(Q.stem_of))]
    keys = [{"document_id": i} for i in range(4_094)] + [None, {"document_id": 5_000}]
    batch = pa.RecordBatch.from_arrays([pa.array([held] * 60), pa.array([keys] * 60)], names=["rows", "info"])
    want, found = Q.parse("alpha"), []
    used = peak(lambda: found.extend(P._best(iter([batch]), want, {"alpha"}, 3, ("document_id",))))
    assert found == [(-0.4, ((True, 5_000),))] * 3 and used < 4 << 20, used


def test_no_passages_and_equal_keys(spark):
    path = built(spark, [(1, "ready", "", "alpha"), (1, "ready", "", "alpha")])
    assert [r.document_id for r in pool(spark, path, "alpha", 5).collect()] == [1, 1]
    path = built(spark, [(1, "ready", None, None)])
    assert pool(spark, path, "alpha", 5).count() == 0
    assert pool(spark, built(spark, []), "alpha", 5).count() == 0


def test_full_stems_in_search(spark):
    rows = {r.document_id: r for r in model.documents(spark, SF).collect()}
    got = indexed.search_stemmed(spark, SF).collect()
    old_stem = Q.stem_of
    import tests.test_questions as T

    wants = Q.parse(indexed.ENGLISH, stem=english)
    assert any(english(w) != old_stem(w) for w in ("onening", "ndering", "tions", "generously"))
    cut = lambda t: [english(w) for w in P._term(t.lower())]
    stemmed = {i: (" ".join(cut(f"{r.filename} > {r.workspace_id}")), " ".join(cut(r.content or ""))) for i, r in rows.items()}

    class Plain:  # texts and question in stems already
        stem_of = staticmethod(lambda t: t)
        parse = staticmethod(lambda q: wants)

    real, T.Q = T.Q, Plain
    try:
        want = ranked([(i, None, h, b) for i, (h, b) in stemmed.items()], indexed.ENGLISH, 50)
    finally:
        T.Q = real
    assert [(r.document_id, r.text_rank) for r in sorted(got, key=lambda r: r.text_rank)] == [(i, n) for i, _, n in want]

"""The vector index: recall against all distances, all rows indexed, cells read in part, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.operators import ann
from docquarry.operators import retrieval as R
from docquarry.plans import search as S
from docquarry.session import scratch_folder

VECTORS = "document_id long, embedding array<float>"


def clustered(n, width=16, groups=25, seed=4):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((groups, width)) * 3
    return [(i, [float(x) for x in centers[i % groups] + rng.standard_normal(width)]) for i in range(n)]


def index_of(spark, rows, **how):
    vectors = spark.createDataFrame(rows, VECTORS).repartition(3)
    path = scratch_folder(spark, "ann-test")
    assert ann.build_index(vectors, path, **how)
    return path, vectors, vectors.where("document_id % 50 = 0").select(F.col("document_id").alias("query_id"), "embedding")


def recall(spark, path, vectors, queries, k=10, **how):
    true = {(r.query_id, r.document_id) for r in R.nearest(queries, vectors, k).collect()}
    found = ann.search(path, queries, vectors, k, **how).collect()
    return len(true & {(r.query_id, r.document_id) for r in found}) / len(true), found


def test_recall_of_the_registered_query(spark):
    rows = S.vector_ann_recall(spark, "/root/testdata/sf0.01").collect()
    assert sum(r.n_found for r in rows) >= 0.9 * sum(r.n_true for r in rows) == 9 * len(rows)
    assert all(r.rows_read < 500 for r in rows)


def test_indexes_every_row_and_reads_a_part(spark):
    path, vectors, queries = index_of(spark, clustered(3_000))
    blocks = spark.read.parquet(f"{path}/blocks")
    ids = [i for r in blocks.collect() for i in r.ids]
    assert sorted(ids) == list(range(3_000))
    model = ann.read_model(spark, path)
    assert model.probes < len(model.centroids) / 2
    got, found = recall(spark, path, vectors, queries)
    assert got >= 0.9
    by_query = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        by_query.setdefault(r.query_id, []).append(r)
    assert all([r.rank for r in rows] == list(range(1, 11)) and rows[0].document_id == q and [r.distance for r in rows] == sorted(r.distance for r in rows) for q, rows in by_query.items())


def test_one_question_opens_its_cells_only(spark):
    path, vectors, queries = index_of(spark, clustered(2_000))
    one = queries.where("query_id = 50")
    plan = ann.search(path, one, vectors, 5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    probes = ann.read_model(spark, path).probes
    assert ann._routed(one, ann.read_model(spark, path), probes).select("cell").distinct().count() == probes


@pytest.mark.parametrize(("block", "side"), [(16, 1), (4_096, 16)])
def test_a_hot_vector_and_many_blocks(spark, monkeypatch, block, side):
    """A third of all rows are one vector: its cell has many blocks, dealt to several tasks; all cells read find all that is near."""
    monkeypatch.setattr(ann, "BLOCK", block)
    monkeypatch.setattr(ann, "PACK", block)
    monkeypatch.setattr(ann, "TASK_SIDE", side)
    rows = clustered(1_200)
    rows = [(i, rows[7][1] if i % 3 == 0 else v) for i, v in rows]
    path, vectors, queries = index_of(spark, rows, cells=12)
    got, found = recall(spark, path, vectors, queries, probes=12)
    hot = [r for r in found if r.query_id == 0]
    assert len(hot) == 10 and all(abs(r.distance) < 1e-9 for r in hot)
    assert sum(len(r.ids) for r in spark.read.parquet(f"{path}/blocks").collect()) == 1_200
    other = [r for r in found if r.query_id % 3]
    true = {(r.query_id, r.document_id) for r in R.nearest(queries.where("query_id % 3 > 0"), vectors, 10).collect()}
    assert len(true & {(r.query_id, r.document_id) for r in other}) >= 0.95 * len(true)


def test_odd_vectors(spark):
    rows = [*clustered(400), (1_000, None), (1_001, []), (1_002, [0.0] * 16), (1_003, [1.0] * 3), (1_004, [float("nan")] * 16), (1_005, [None] * 16), (None, [1.0] * 16), (7, clustered(400)[7][1])]
    path, vectors, _ = index_of(spark, rows)
    assert sorted(i for r in spark.read.parquet(f"{path}/blocks").collect() for i in r.ids) == sorted([*range(400), 7])
    asked = spark.createDataFrame([(1, rows[7][1]), (2, None), (3, [0.0] * 16), (4, [1.0]), (None, rows[7][1])], "query_id long, embedding array<float>")
    found = ann.search(path, asked, vectors, 3).collect()
    assert {r.query_id for r in found} == {1} and found[0].document_id == 7
    assert not ann.build_index(vectors.where("false"), scratch_folder(spark, "none"))
    assert not ann.build_index(vectors.where("embedding IS NULL"), scratch_folder(spark, "none"))


def test_one_vector_alone(spark):
    path, vectors, _ = index_of(spark, [(5, [3.0, 4.0])])
    asked = spark.createDataFrame([(1, [3.0, 4.1])], "query_id long, embedding array<float>")
    assert [(r.document_id, r.rank) for r in ann.search(path, asked, vectors, 3).collect()] == [(5, 1)]

"""The given tables as the engine's model: tenants, documents, vectors, jobs, chats.

A tenant is a language, a file name a source, upload order the document id. A document's status comes
from its label row: none is pending, quality 0 failed, toxic 1 embedding, the rest ready.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.session import prepare, table


def _status():
    return F.when(F.col("quality").isNull(), "pending").when(F.col("quality") == 0, "failed").when(F.col("toxic") == 1, "embedding").otherwise("ready")


def statuses(labels: DataFrame) -> DataFrame:
    """(document_id, status) of the labelled documents."""
    return labels.select(F.col("doc_id").alias("document_id"), _status().alias("status"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(workspace_id, document_id, filename, content, status)"""
    docs, labels = table(prepare(spark), sf_dir, "documents", spread=True), table(spark, sf_dir, "labels")
    joined = docs.join(labels, "doc_id", "left")
    return joined.select(F.col("lang").alias("workspace_id"), F.col("doc_id").alias("document_id"), F.col("source").alias("filename"), F.col("text").alias("content"), _status().alias("status"))


#: The same in SQL.
DOCUMENTS_SQL = """docs AS (
  SELECT d.lang AS workspace_id, d.doc_id AS document_id, d.source AS filename, d.text AS content,
    CASE WHEN l.quality IS NULL THEN 'pending' WHEN l.quality = 0 THEN 'failed' WHEN l.toxic = 1 THEN 'embedding' ELSE 'ready' END AS status
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, embedding, tag)"""
    return table(prepare(spark), sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), "embedding", F.col("label").alias("tag"))


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, ts, event, value): a user's events are a job's."""
    return table(prepare(spark), sf_dir, "events").select(F.col("user_id").alias("job_id"), "ts", F.col("event_type").alias("event"), "value", "event_id")

"""Streaming queries over the given tables, run to the end of what there is, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.plans import tenancy
from docquarry.session import prepare
from docquarry.streaming import ingest as I


def stream_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a stream: the same states as from the whole table."""
    log = I.source(prepare(spark), f"{sf_dir}/events.parquet").select(F.col("user_id").alias("job_id"), "ts", F.col("event_type").alias("event"), "event_id")
    folder = I.fresh_folder(spark, "states")
    I.state_stream(log, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return I.latest_states(spark, f"{folder}/out").select("job_id", "status", "attempts")


def stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream, chunked batch by batch."""
    docs = I.source(prepare(spark), f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"))
    folder = I.fresh_folder(spark, "chunks")
    I.chunk_stream(docs, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return I.latest_chunks(spark, f"{folder}/out").select("document_id", "ordinal", "content", "token_count")


def stream_stalled_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a stream with a timer a job: the jobs that are stalled when the newest event is the watermark."""
    log = I.source(prepare(spark), f"{sf_dir}/events.parquet").select(F.col("user_id").alias("job_id"), "ts", F.col("event_type").alias("event"), "event_id")
    folder = I.fresh_folder(spark, "stalled")
    I.stalled_stream(log, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return I.stalled_now(spark, f"{folder}/out").select("job_id", "attempts", "next_status")


QUERIES = {f.__name__: f for f in (stream_job_states, stream_chunks, stream_stalled_jobs)}
ORACLE_SQL = {
    "stream_job_states": tenancy.ORACLE_SQL["job_states"],
    "stream_stalled_jobs": tenancy.ORACLE_SQL["stalled_jobs"].replace(f"TIMESTAMP '{tenancy.AS_OF}'", "(SELECT max(ts) FROM events)"),
}

"""Searches by a positional index of the given texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.stemmer import english
from docquarry.operators import postings as P
from docquarry.operators import questions as Q
from docquarry.operators.retrieval import pool_size
from docquarry.plans import asking, search
from docquarry.session import prepare, scratch_folder, table

ENGLISH = 'onening the or "ndering tions" -onwhs'


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whatever their status, so that no text is exchanged for it."""
    docs = table(prepare(spark), sf_dir, "documents", spread=True)
    return docs.select(F.col("doc_id").alias("document_id"), F.concat_ws(" > ", "source", "lang").alias("header"), F.col("text").alias("content"))


def search_question_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What search_question finds, by an index of all documents."""
    path = scratch_folder(spark, "postings")
    docs = _documents(spark, sf_dir)
    P.build(docs, path, ("document_id",))
    found = P.question_pool(docs, path, asking.QUESTION, 32, ("document_id",))
    return found.select("document_id", "text_rank", F.round("text_score", 6).alias("text_score"))


def search_chunks_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What search_chunks finds, by an index of all passages; only ready documents' passages take part."""
    path, passages = scratch_folder(spark, "postings"), asking._passages(spark, sf_dir)
    P.build(asking._lines(spark, sf_dir), path, ("document_id", "ordinal"), ("status",))
    text = P.question_pool(passages, path, asking.SHORT, pool_size(8), ("document_id", "ordinal"), ("status",), lambda r: r["status"] == "ready")
    best = Q.search_chunks(passages, asking.SHORT, search._query(spark, sf_dir), 8, text=text)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return best.select("document_id", "ordinal", "filename", "header", F.col("tags.document_type").alias("document_type"), F.round("score", 5).alias("score"), zero("vec_rank"), zero("text_rank"), "snippet")


def search_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents that answer a question best, words matched by full English stems."""
    path = scratch_folder(spark, "postings")
    docs = _documents(spark, sf_dir)
    P.build(docs, path, ("document_id",), stem=english)
    found = P.question_pool(docs, path, ENGLISH, 50, ("document_id",), stem=english)
    return found.select("document_id", "text_rank", F.round("text_score", 6).alias("text_score"))


def stemmed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms of the documents with their English stems, and how many documents have them."""
    return P.corpus_stems(table(prepare(spark), sf_dir, "documents", spread=True), "text", english)


QUERIES = {f.__name__: f for f in (search_question_indexed, search_chunks_indexed, search_stemmed, stemmed_terms)}
ORACLE_SQL = {"search_question_indexed": asking.ORACLE_SQL["search_question"], "search_chunks_indexed": asking.ORACLE_SQL["search_chunks"]}

"""The corpus pipeline: documents in, token digests of the documents kept out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import bpe, decontaminate, langid, nearcopies, simhash, toxicity
from docquarry.session import cut_lineage, prepare, remove_folder, shared_folder, table

ORACLE_SQL = None  # hashing, training and tokenizing stages have no SQL form; tests hold a brute-force version


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language can't be told, go."""
    prepare(spark)
    return langid.keep_identified(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    prepare(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that op9's links or a 5-word Jaccard similarity of 0.8 hold together."""
    prepare(spark)
    sketched = cut_lineage(nearcopies.sketches(docs))
    return simhash.keep_one_of_each(docs, links=nearcopies.near_copy_links(docs, sketched), prints=sketched.select("doc_id", "h", "fp"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    prepare(spark)
    return decontaminate.keep_uncontaminated(docs, decontaminate.items_of(table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document left."""
    prepare(spark)
    return bpe.encode(docs, keep="digests")


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("bpe_encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each on what its predecessor kept.

    Between stages documents are written as Parquet to the shared folder and read again; what a stage has read is
    removed when the next one has written, and the last stage's input when the session ends.
    """
    docs = table(prepare(spark), sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, before)
        before = f"{folder}/{name}"
    _at_end(spark, folder)
    return STAGES[-1][1](spark, docs, sf_dir)


def _at_end(spark: SparkSession, folder: str) -> None:
    """Removes the folder with the session: the result is read from it until then."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)

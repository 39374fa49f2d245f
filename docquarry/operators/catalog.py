"""Catalogue reports and changes: cards, counts, vocabularies, upserts, deletes, versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.operators.ranges import change_numbers, row_numbers

WORKING = ("parsing", "profiling", "chunking", "embedding", "pending")


def status_counts(docs: DataFrame) -> DataFrame:
    """(workspace_id, total, ready, failed, in_progress, by_status), and last_change of documents that have ``changed_at``."""
    changed = [F.max("changed_at").alias("last_change")] if "changed_at" in docs.columns else []
    per = docs.groupBy("workspace_id", "status").agg(F.count("*").alias("n"), *changed)
    pick = lambda *s: F.coalesce(F.sum(F.when(F.col("status").isin(*s), F.col("n"))), F.lit(0))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("status", "n"))), lambda x: F.concat(x["status"], F.lit("="), x["n"].cast("string")))
    return per.groupBy("workspace_id").agg(F.sum("n").alias("total"), pick("ready").alias("ready"), pick("failed").alias("failed"), pick(*WORKING).alias("in_progress"), F.array_join(pairs, ",").alias("by_status"), *[F.max("last_change").alias("last_change") for _ in changed])


def stored_bytes(files: DataFrame, workspace_id: str, document_id: int) -> bytes:
    """The bytes of one stored file (workspace_id, document_id, content); another tenant's file isn't there."""
    found = files.where((F.col("workspace_id") == workspace_id) & (F.col("document_id") == document_id)).select("content").take(1)
    if not found:
        raise LookupError(f"no file {document_id} in {workspace_id}")
    return bytes(found[0]["content"])


def value_counts(docs: DataFrame, kinds: dict[str, Column], group: str = "workspace_id") -> DataFrame:
    """(workspace, kind, value, n): how often each value of each kind occurs; arrays count each element."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("value")) for k, c in kinds.items()])
    rows = docs.select(group, F.explode(pairs).alias("p")).select(group, "p.kind", "p.value")
    return rows.where("value IS NOT NULL").groupBy(group, "kind", "value").agg(F.count("*").alias("n"))


def top_values(counts: DataFrame, k: int, by: Sequence[str]) -> DataFrame:
    """The k most frequent values of each group, with ``rank``; equal counts go by value."""
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vocabulary(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counted values as one map a group; built anew, so that reruns never count twice."""
    return counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("counts"))


def distinct_spellings(values: Column, most: int = 12) -> Column:
    """Trimmed non-empty values, each once whatever its case, first spelling and order kept, ``most`` at most."""
    clean = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")
    both = F.transform(clean, lambda v: F.struct(v.alias("v"), F.lower(v).alias("l")))
    # the array of one binds the words, so that they are made once for a text
    return F.transform(F.array(both), lambda b: F.transform(F.slice(F.array_distinct(b["l"]), 1, most), lambda x: F.element_at(b["v"], F.array_position(b["l"], x).cast("int"))))[0]


def workspace_cards(workspaces: DataFrame, docs: DataFrame, chunks: DataFrame, messages: DataFrame, topics: DataFrame) -> DataFrame:
    """One row a workspace; counts are made before the joins, so each joins one row."""
    counted = status_counts(docs).drop("by_status")
    chunk_counts = chunks.groupBy("workspace_id").agg(F.count("*").alias("chunks"))
    asked = messages.where("role = 'user'").groupBy("workspace_id").agg(F.max("turn").alias("last_question"))
    best = topics.groupBy("workspace_id").agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("t"))
    best = best.select("workspace_id", F.array_join(F.col("t.value"), ",").alias("topics"))
    out = workspaces
    for part in (counted, chunk_counts, asked, best):
        out = out.join(part, "workspace_id", "left")
    zero = {c: 0 for c in ("total", "ready", "failed", "in_progress", "chunks")}
    return out.fillna(zero | {"topics": ""})


def document_list(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their number of chunks, 0 where there is none."""
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"))
    return docs.join(counts, "document_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))


def corpus_state(docs: DataFrame) -> DataFrame:
    """(workspace_id, n_ready, names, processing): names is an array of the ready files' distinct names, sorted."""
    names = F.array_sort(F.collect_set(F.when(F.col("status") == "ready", F.col("filename"))))
    return docs.groupBy("workspace_id").agg(F.count(F.when(F.col("status") == "ready", 1)).alias("n_ready"), names.alias("names"), F.count(F.when(F.col("status").isin(*WORKING), 1)).alias("processing"))


def live_sessions(sessions: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """Sessions not yet expired at ``as_of`` with their users; expired ones are what a purge deletes."""
    return sessions.where(F.col("expires_at") > as_of).join(users, "user_id")


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` in place of those with their key, the rest as they were. Running it twice changes nothing."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def delete_where(rows: DataFrame, cond: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, deleted); rows for which the condition is null are kept."""
    sure = F.coalesce(cond, F.lit(False))
    return rows.where(~sure), rows.where(sure)


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    """(kept, deleted) rows of every table, by the keys in ``gone``; rows with a null key are kept. Deleting again deletes nothing."""
    keys = gone.select(key).where(F.col(key).isNotNull()).distinct()
    return {name: (t.join(keys, key, "left_anti"), t.join(keys, key, "left_semi")) for name, t in tables.items()}


def cascade_counts(docs: DataFrame, chunks: DataFrame, messages: DataFrame) -> DataFrame:
    """What deleting each workspace would remove: (workspace_id, documents, chunks, messages)."""
    kinds = (("documents", docs), ("chunks", chunks), ("messages", messages))
    rows = [df.groupBy("workspace_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind)) for kind, df in kinds]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return every.groupBy("workspace_id").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k, _ in kinds])


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(document_id, file_hash, first_id, duplicate): a ready earlier document with the same bytes makes a duplicate."""
    h = F.sha2(F.col("content"), 256)
    hashed = docs.select("workspace_id", "document_id", "status", h.alias("file_hash"))
    first = hashed.where("status = 'ready'").groupBy("workspace_id", "file_hash").agg(F.min("document_id").alias("first_id"))
    out = hashed.join(first, ["workspace_id", "file_hash"], "left")
    return out.select("document_id", "file_hash", "first_id", F.coalesce(F.col("first_id") < F.col("document_id"), F.lit(False)).alias("duplicate"))


def version_chain(docs: DataFrame) -> DataFrame:
    """(document_id, version, superseded): uploads of one file name in order; new bytes make a new version."""
    hashed = docs.select("workspace_id", "filename", "document_id", F.sha2(F.col("content"), 256).alias("h"))
    numbered = change_numbers(hashed, ("workspace_id", "filename"), ("document_id",), "h", "n", "superseded")
    return numbered.select("document_id", F.concat(F.lit("v"), F.col("n").cast("string")).alias("version"), "superseded")


def next_version(label: Column) -> Column:
    """v{n} to v{n+1}; any other label to v2."""
    n = F.regexp_extract(label, r"^v(\d+)$", 1)
    return F.when(n != "", F.concat(F.lit("v"), (n.cast("long") + 1).cast("string"))).otherwise(F.lit("v2"))


def pending_batches(chunks: DataFrame, vectors: DataFrame, size: int = 32) -> DataFrame:
    """(document_id, batch): chunks without a vector, in batches within each workspace."""
    left = chunks.join(vectors.select("document_id"), "document_id", "left_anti")
    numbered = row_numbers(left.select("workspace_id", "document_id"), ("workspace_id",), ("document_id",))
    return numbered.select("workspace_id", "document_id", F.floor((F.col("n") - 1) / size).cast("long").alias("batch"))


def status_log(log: DataFrame) -> DataFrame:
    """(document_id, status, page_count, indexed_at, error_message) after all changes (document_id, ts, seq, status, page_count, error_message).

    The last change by time, then by seq, tells the status and the error; a page count stays until another is told; indexed_at is when the
    document last became ready, null where a later change has sent it back.
    """
    order = F.struct("ts", "seq")
    last = F.max_by(F.struct("status", "error_message", "ts"), order)
    per = log.groupBy("document_id").agg(last.alias("l"), F.max_by("page_count", F.when(F.col("page_count").isNotNull(), order)).alias("page_count"))
    ready = F.col("l.status") == "ready"
    return per.select("document_id", "l.status", "page_count", F.when(ready, F.col("l.ts")).alias("indexed_at"), F.when(F.col("l.status") == "failed", F.col("l.error_message")).alias("error_message"))


def listing(rows: DataFrame, group: list[str], order: str, newest_first: bool) -> DataFrame:
    """The rows with ``position`` (from 1) in their group's list, by ``order`` (a number that tells them apart), over spread groups."""
    key = "__order"
    placed = row_numbers(rows.withColumn(key, F.negative(F.col(order)) if newest_first else F.col(order)), group, [key], "position")
    return placed.drop(key)


def global_counts(jobs: DataFrame, chunks: DataFrame, vectors: DataFrame, messages: DataFrame, users: DataFrame) -> DataFrame:
    """One row: pending jobs, chunks without a vector, messages and users of all workspaces."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    out = count(jobs.where(F.col("status") == "pending"), "pending_jobs")
    for df, name in ((chunks.join(vectors.select("document_id"), "document_id", "left_anti"), "pending_embeddings"), (messages, "messages"), (users, "users")):
        out = out.join(F.broadcast(count(df, name)))  # one row each
    return out

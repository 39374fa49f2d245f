"""Structured Streaming forms of ingest and of the job queue's state.

Both read a folder as a stream with the availableNow trigger, keep their progress in a checkpoint, and write
each micro-batch under its own number, so that a batch run again replaces what it wrote.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docquarry.operators import chunking as C
from docquarry.operators import jobs as J
from docquarry.session import shared_folder


def source(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """Parquet files as a stream, with the schema that they have now.

    The path may be a folder or one file; as a glob it isn't taken for a partitioned table's root.
    """
    glob = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(glob)


#: Groups that documents are dealt to by a hash of their ids; a checkpoint belongs to one number of them.
BUCKETS = 4_096
_ENTRY = np.dtype([("document_id", "<i8"), ("seq", "<i8"), ("digest", "S32")])


def _newest(frames: list[pd.DataFrame]) -> pd.DataFrame:
    """Each document's row of the largest seq, of equal ones that of the largest digest."""
    return pd.concat(frames).sort_values(["document_id", "seq", "digest"]).drop_duplicates("document_id", keep="last")


def _changed(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Of a bucket's documents the last row of this batch each, if it isn't older than the last one seen and its content isn't the same.

    The state is the bucket's (document_id, seq, digest), sorted by id, as one string of bytes. ``again`` tells documents that were given out in an earlier batch.
    """
    parts, size, most = [], 0, 4_096
    for frame in frames:
        parts, size = [*parts, frame], size + len(frame)
        if size > 2 * most:  # rows that a later one replaces aren't held
            parts = [_newest(parts)]
            size = len(parts[0])
            most = max(most, size)
    last = _newest(parts)
    own = np.empty(len(last), _ENTRY)
    for name in ("document_id", "seq"):
        own[name] = last[name].to_numpy()
    own["digest"] = [bytes(x) for x in last["digest"]]
    seen = np.frombuffer(state.get[0], _ENTRY) if state.exists else np.empty(0, _ENTRY)
    at = np.searchsorted(seen["document_id"], own["document_id"])
    again = np.zeros(len(own), bool)
    again[at < len(seen)] = seen["document_id"][at[at < len(seen)]] == own["document_id"][at < len(seen)]
    newer, same = np.ones(len(own), bool), np.zeros(len(own), bool)
    newer[again] = own["seq"][again] >= seen["seq"][at[again]]
    same[again] = own["digest"][again] == seen["digest"][at[again]]
    held = seen.copy()
    held[at[again & newer]] = own[again & newer]
    held = np.insert(held, at[~again], own[~again])
    if len(held) > len(seen) or (held != seen).any():
        state.update((held.tobytes(),))
    cut = newer & ~same
    if cut.any():
        yield last.loc[cut, ["document_id", "content"]].assign(again=again[cut], bucket=key[0])


def chunk_stream(docs: DataFrame, out: str, checkpoint: str, target: int = C.TARGET) -> StreamingQuery:
    """Documents (document_id, content[, seq]) to chunk files; a document that comes again is cut again only if its content changed.

    Spark's state store holds two numbers and a digest a document, in buckets of documents, so that a task calls Python once a bucket and
    not once a document. A batch reads and writes the states of the buckets that its rows are in, and no text that was written before. Of a
    document's rows that of the largest seq counts; an older one that comes in a later batch changes nothing. A batch's documents and chunks go to its own folder, so a crash
    between writing and committing leaves no doubles; ``latest_chunks`` reads the newest of each document.
    """
    seq = F.coalesce(F.col("seq").cast("long"), F.lit(-(1 << 63))) if "seq" in docs.columns else F.lit(0).cast("long")
    number = F.col("document_id").cast("long")
    bucket = F.when(number.isNull(), -1).otherwise(F.pmod(F.xxhash64(number), F.lit(BUCKETS))).cast("int")  # that of no number is its own
    keyed = docs.select(bucket.alias("bucket"), F.coalesce(number, F.lit(0)).alias("document_id"), F.coalesce(F.col("content"), F.lit("")).alias("content"), seq.alias("seq")).withColumn("digest", F.unhex(F.sha2("content", 256)))
    given = keyed.groupBy("bucket").applyInPandasWithState(_changed, "document_id long, content string, again boolean, bucket int", "seen binary", "append", GroupStateTimeout.NoTimeout)
    changed = given.select(F.when(F.col("bucket") >= 0, F.col("document_id")).alias("document_id"), "content", "again")

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        held.select("document_id", "again").write.mode("overwrite").parquet(f"{out}/documents/batch={number}")
        chunks = C.assemble(C.paragraphs(held), target=target)
        chunks.withColumnRenamed("doc_id", "document_id").write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        held.unpersist()

    return changed.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_chunks(spark: SparkSession, out: str) -> DataFrame:
    """Chunks of each document's newest content; only what was cut again is looked up, and nothing is exchanged where nothing was."""
    chunks = spark.read.parquet(f"{out}/chunks")
    again = spark.read.parquet(f"{out}/documents").where("again")
    if again.isEmpty():
        return chunks.drop("batch")
    newest = again.groupBy(F.col("document_id").alias("id")).agg(F.max("batch").alias("newest"))
    return chunks.join(newest, F.col("document_id").eqNullSafe(F.col("id")), "left").where("newest IS NULL OR batch = newest").drop("batch", "id", "newest")


def state_stream(log: DataFrame, out: str, checkpoint: str, compact_every: int = 20) -> StreamingQuery:
    """Event log (job_id, ts, event, event_id) to the jobs' latest states, one row a job in Spark's state store.

    Each batch writes the states that it changed; every ``compact_every`` batches all latest states are written as one
    snapshot, so that readers need the newest snapshot and what came after it.
    """
    states = J.job_states(log)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/kind=change/batch={number}")
        if number and number % compact_every == 0:
            latest_states(batch.sparkSession, out, number).write.mode("overwrite").parquet(f"{out}/kind=snapshot/batch={number}")

    return states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_states(spark: SparkSession, out: str, upto: int | None = None) -> DataFrame:
    """The newest state of each job; only the last snapshot and later changes are read."""
    rows = spark.read.parquet(out)
    rows = rows if upto is None else rows.where((F.col("batch") <= upto) & ~((F.col("kind") == "snapshot") & (F.col("batch") == upto)))
    base = rows.where("kind = 'snapshot'").agg(F.max("batch")).first()[0]
    rows = rows if base is None else rows.where(((F.col("kind") == "snapshot") & (F.col("batch") == base)) | ((F.col("kind") == "change") & (F.col("batch") > base)))
    names = [c for c in rows.columns if c not in ("job_id", "kind", "batch")]
    best = rows.groupBy("job_id").agg(F.max_by(F.struct(*names), "batch").alias("s"))
    return best.select("job_id", "s.*")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


class _Heartbeats(StatefulProcessor):
    """One job: (last event's microsecond and number, attempts, event, whether it was told as stalled), and a timer where its heartbeat runs out."""

    def __init__(self, timeout: int):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "us long, event_id long, attempts int, event string, told boolean")

    def _running(self, event: str) -> bool:
        return event not in J.ENDS

    def handleInputRows(self, key, rows, timerValues):
        seen = self.state.get() if self.state.exists() else None
        us, number, attempts, event, told = seen if seen is not None else (None, -1, 0, None, False)
        for row in rows:
            attempts += row.event == "error"
            if us is None or (row.us, row.event_id) > (us, number):
                us, number, event = row.us, row.event_id, row.event
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.update((us, number, attempts, event, False))
        if self._running(event):
            self.handle.registerTimer(self._due(us))
        if told:
            yield Row(job_id=key[0], us=us, attempts=attempts, stalled=False)

    def _due(self, us: int) -> int:
        """The millisecond at which a heartbeat (in microseconds) is older than the timeout."""
        return us // 1000 + self.timeout * 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        us, number, attempts, event, _ = self.state.get()
        self.state.update((us, number, attempts, event, True))
        yield Row(job_id=key[0], us=us, attempts=attempts, stalled=True)

    def close(self) -> None:
        pass


def stalled_stream(log: DataFrame, out: str, checkpoint: str, timeout: int = J.TIMEOUT_SECONDS, delay: str = "0 seconds") -> StreamingQuery:
    """Event log (job_id, ts, event, event_id) to the jobs whose heartbeat runs out, by a timer of event time for each job.

    A running job that is silent for ``timeout`` seconds before the watermark is told as stalled, and told as alive again by its next
    event. State is one row and one timer a job; jobs that have ended have no timer. Events older than the watermark, the newest event less
    ``delay``, are dropped by Spark. Each batch writes its changes under its number; ``stalled_now`` reads the newest of each job.
    """
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = log.select(F.col("job_id").cast("long").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event", F.col("event_id").cast("long").alias("event_id")).where("job_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
    told = rows.groupBy("job_id").transformWithState(_Heartbeats(timeout), "job_id long, us long, attempts int, stalled boolean", "update", "eventTime")

    def write(batch: DataFrame, number: int) -> None:
        batch.select("job_id", F.timestamp_micros("us").alias("heartbeat_at"), "attempts", "stalled").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return told.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stalled_now(spark: SparkSession, out: str) -> DataFrame:
    """(job_id, heartbeat_at, attempts, next_status) of the jobs that are stalled."""
    rows = spark.read.schema("job_id long, heartbeat_at timestamp, attempts int, stalled boolean, batch long").parquet(out)
    last = rows.groupBy("job_id").agg(F.max_by(F.struct("heartbeat_at", "attempts", "stalled"), F.struct("batch", "stalled")).alias("s")).where("s.stalled")
    return last.select("job_id", "s.heartbeat_at", "s.attempts", F.when(F.col("s.attempts") >= J.MAX_ATTEMPTS, "failed").otherwise("pending").alias("next_status"))

"""The leased job queue as queries over its event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.operators.ranges import row_numbers

# fixed values: attempts, heartbeat timeout, retryable replies
MAX_ATTEMPTS = 3
TIMEOUT_SECONDS = 3600
RETRYABLE_STATUS = (408, 429, 500, 502, 503, 504)
RETRYABLE_TEXT = ("rate limit", "resource exhausted", "resource_exhausted", "deadline exceeded", "unavailable", "internal error", "overloaded", "timeout", "connection reset")
RETRYABLE_TYPES = ("ReadError", "WriteError", "ConnectError", "CloseError", "ConnectTimeout", "ReadTimeout", "WriteTimeout", "PoolTimeout", "NetworkError", "ProxyError", "RemoteProtocolError", "TransportError", "ServerDisconnectedError", "IncompleteRead", "TimeoutError", "ConnectionError", "OSError")
RATE_LIMIT_STATUS, RATE_LIMIT_TEXT = 429, ("resource_exhausted", "resource exhausted")
MAX_SERVER_DELAY = 65.0
SERVER_JITTER, LOCAL_JITTER, FAIL_FAST_SECONDS = (0.5, 2.0), (0.5, 1.5), 8.0
ENDS = ("purchase", "signup", "error")  # after these a job isn't running
STAGE_PROGRESS = {"parse": 10, "profile": 25, "chunk": 40, "write": 50}


def job_states(log: DataFrame) -> DataFrame:
    """(job_id, status, heartbeat_at, created_at, attempts): the last event decides.

    signup queues a job, view and click are heartbeats of a running one, purchase ends it, error is a failed attempt: with
    attempts left the job is pending again, else failed.
    """
    last = F.max_by("event", F.struct("ts", "event_id"))
    per = log.groupBy("job_id").agg(last.alias("last"), F.max("ts").alias("heartbeat_at"), F.min("ts").alias("created_at"), F.count(F.when(F.col("event") == "error", 1)).alias("attempts"))
    status = F.when(F.col("last") == "purchase", "succeeded").when(F.col("last") == "signup", "pending").when(F.col("last") == "error", F.when(F.col("attempts") >= MAX_ATTEMPTS, "failed").otherwise("pending")).otherwise("running")
    return per.select("job_id", status.alias("status"), "heartbeat_at", "created_at", "attempts")


def stalled(states: DataFrame, as_of: Column, timeout: int = TIMEOUT_SECONDS) -> DataFrame:
    """Running jobs whose heartbeat is older than the timeout, and what becomes of them."""
    old = F.coalesce("heartbeat_at", "created_at") < as_of - F.make_interval(secs=F.lit(timeout))
    return states.where((F.col("status") == "running") & old).withColumn("next_status", F.when(F.col("attempts") >= MAX_ATTEMPTS, "failed").otherwise("pending"))


def claim_order(states: DataFrame, n: int) -> DataFrame:
    """The n oldest pending jobs, as a worker would claim them."""
    return states.where("status = 'pending'").orderBy("created_at", "job_id").limit(n).withColumn("attempts", F.col("attempts") + 1)


def progress(done: Column, total: Column) -> Column:
    """50 when embedding begins, 100 when all is done."""
    return (F.lit(50) + F.floor(F.when(total > 0, done * 50 / total).otherwise(F.lit(50)))).cast("int")


def stage_progress(stage: Column, done: Column, total: Column) -> Column:
    """Percent of an ingest job by its stage; embedding counts what is done."""
    fixed = F.coalesce(*[F.when(stage == name, F.lit(pct)) for name, pct in STAGE_PROGRESS.items()])
    return F.when(stage == "embed", progress(done, total)).when(stage == "done", F.lit(100)).otherwise(F.coalesce(fixed, F.lit(0)))


def retryable(code: Column, message: Column, types: Column | None = None) -> Column:
    """Whether to try again: by reply code, by text, or by the names of the error's class and its parents (an array)."""
    text = F.lower(F.coalesce(message, F.lit("")))
    known = F.lit(False) if types is None else F.coalesce(F.arrays_overlap(types, F.array(*map(F.lit, RETRYABLE_TYPES))), F.lit(False))
    return F.coalesce(code.isin(*RETRYABLE_STATUS), F.lit(False)) | known | text.rlike("|".join(RETRYABLE_TEXT))


def rate_limited(code: Column, message: Column) -> Column:
    """Whether a reply says that the quota is used up, which the bare word quota doesn't."""
    text = F.lower(F.coalesce(message, F.lit("")))
    return F.coalesce(code == RATE_LIMIT_STATUS, F.lit(False)) | text.rlike("|".join(RATE_LIMIT_TEXT))


def retry_wait(attempt: Column, server: Column, chance: Column, interactive: bool = False) -> Column:
    """Seconds until the next attempt, null where there is none.

    ``chance`` (0 to 1) spreads the wait: added to what the server asked for, else multiplied with the local backoff. A caller
    who waits for the answer gives up where it would take over FAIL_FAST_SECONDS.
    """
    spread = lambda lo, hi: F.lit(lo) + (hi - lo) * chance
    wait = F.coalesce(server + spread(*SERVER_JITTER), backoff(attempt) * spread(*LOCAL_JITTER))
    return F.when(wait <= FAIL_FAST_SECONDS, wait) if interactive else wait


def server_delay(message: Column) -> Column:
    """Seconds the server asked to wait, capped; null if it named none."""
    plain, field = F.regexp_extract(message, r"(?i)retry in ([0-9.]+)\s*s", 1), F.regexp_extract(message, r"(?i)retryDelay['\"]?\s*[:=]\s*['\"]?([0-9.]+)s", 1)
    said = F.when(plain != "", plain).when(field != "", field)
    return F.least(F.expr("CAST(NULL AS DOUBLE)") if said is None else said.try_cast("double"), F.when(said.isNotNull(), F.lit(MAX_SERVER_DELAY)))


def backoff(attempt: Column, base: float = 1.0, most: float = 60.0) -> Column:
    """Centre of the local wait before an attempt's retry; callers spread it by chance."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(most))


def append_events(log: DataFrame, jobs: DataFrame, event: str, at: Column) -> DataFrame:
    """The log (job_id, ts, event, event_id) with one more event of each job: signup queues it, view is the heartbeat of a running one.

    New events are numbered after the log's, by job.
    """
    last = log.agg(F.coalesce(F.max("event_id"), F.lit(0)).alias("__last"))  # one row
    numbered = row_numbers(jobs.select("job_id").distinct().withColumn("__all", F.lit(0)), ("__all",), ("job_id",), "__n")
    fresh = numbered.join(F.broadcast(last)).select("job_id", at.alias("ts"), F.lit(event).alias("event"), (F.col("__last") + F.col("__n")).alias("event_id"))
    return log.select("job_id", "ts", "event", "event_id").unionByName(fresh)

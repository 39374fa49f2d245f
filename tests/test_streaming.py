"""Streams: the same as the batch forms, resumable, without doubles."""

import random

import pandas as pd
from pyspark.sql import functions as F

from docquarry.operators import chunking as C
from docquarry.operators import jobs as J
from docquarry.streaming import ingest as I


def test_ingest_resumes_and_never_doubles(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    docs = spark.range(60).select(F.col("id").alias("document_id"), F.concat(F.lit("Text number "), F.col("id").cast("string"), F.lit(". It goes on.")).alias("content"))
    docs.where("document_id < 30").coalesce(1).write.parquet(src)
    I.chunk_stream(I.source(spark, src, 1), out, mark).awaitTermination()
    assert I.latest_chunks(spark, out).select("document_id").distinct().count() == 30
    docs.where("document_id >= 20").repartition(3).write.mode("append").parquet(src)
    I.chunk_stream(I.source(spark, src, 1), out, mark).awaitTermination()
    shown = lambda: sorted(map(tuple, I.latest_chunks(spark, out).select("document_id", "ordinal", "content").collect()))
    want = sorted(map(tuple, C.assemble(C.paragraphs(docs)).select("doc_id", "ordinal", "content").collect()))
    assert shown() == want and spark.read.parquet(f"{out}/documents").count() == 60
    I.chunk_stream(I.source(spark, src, 1), out, mark).awaitTermination()
    assert shown() == want
    # new content replaces the old chunks, old content comes back, and an empty text has none
    for content in ("New words.", "", "Text number 5. It goes on."):
        docs.where("document_id = 5").withColumn("content", F.lit(content)).coalesce(1).write.mode("append").parquet(src)
        I.chunk_stream(I.source(spark, src, 1), out, mark).awaitTermination()
        assert [c for d, _, c in shown() if d == 5] == [content] * bool(content)
    assert shown() == want and spark.read.parquet(f"{out}/documents").count() == 63


def test_state_is_one_row_a_bucket_and_new_documents_are_not_exchanged(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    docs = spark.range(9_000).select(F.when(F.col("id") > 0, F.col("id") + (1 << 60)).alias("document_id"), F.concat(F.lit("Text "), F.col("id").cast("string")).alias("content"))
    docs.write.parquet(src)
    query = I.chunk_stream(I.source(spark, src), out, mark)
    query.awaitTermination()
    assert sum(s["numRowsTotal"] for s in query.recentProgress[0]["stateOperators"]) <= I.BUCKETS + 1
    shown = I.latest_chunks(spark, out)
    assert "Exchange" not in shown._jdf.queryExecution().executedPlan().toString()
    want = set(map(tuple, docs.collect()))
    assert set(map(tuple, shown.select("document_id", "content").collect())) == want  # ids beyond doubles, and one that is missing
    spark.createDataFrame([(None, "New."), ((1 << 60) + 1, "New."), ((1 << 60) + 2, "Text 2")], docs.schema).write.mode("append").parquet(src)
    I.chunk_stream(I.source(spark, src), out, mark).awaitTermination()
    want = {(d, "New." if d in (None, (1 << 60) + 1) else c) for d, c in want}
    got = list(map(tuple, I.latest_chunks(spark, out).select("document_id", "content").collect()))
    assert len(got) == 9_000 and set(got) == want


class _State:
    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_a_bucket_gives_out_what_a_document_alone_does():
    """Against one entry a document, with rows that are late, equal, doubled, or many in frames of few."""
    rng, state, seen = random.Random(4), _State(), {}
    for _ in range(60):
        rows = [(rng.choice((-5, 0, 3, 1 << 60, (1 << 60) + 1, *range(10, 60))), rng.randrange(4), rng.randrange(3)) for _ in range(rng.choice((1, 5, 40, 9_000)))]
        frame = pd.DataFrame([(d, f"text {c}", q, bytes([c] * 31 + [0])) for d, q, c in rows], columns=["document_id", "content", "seq", "digest"])
        got = [r for f in I._changed((7,), (frame[lo : lo + 512] for lo in range(0, len(frame), 512)), state) for r in f.itertuples(index=False, name=None)]
        want = []
        for d in sorted({d for d, _, _ in rows}):
            q, c = max((q, c) for x, q, c in rows if x == d)
            if d not in seen or q >= seen[d][0]:
                if d not in seen or seen[d][1] != c:
                    want.append((d, f"text {c}", d in seen, 7))
                seen[d] = q, c
        assert got == want and len(state.get[0]) == 48 * len(seen)


def test_states_follow_the_log(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    log = spark.range(300).select((F.col("id") % 7).alias("job_id"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(secs=F.col("id"))).alias("ts"), F.element_at(F.array(*[F.lit(x) for x in ("signup", "view", "error", "click", "purchase")]), (F.col("id") * 3 % 5 + 1).cast("int")).alias("event"), F.col("id").alias("event_id"))
    for lo, hi in ((0, 100), (100, 300)):
        log.where(f"event_id >= {lo} AND event_id < {hi}").coalesce(1).write.mode("append").parquet(src)
        I.state_stream(I.source(spark, src, 1), out, mark, compact_every=1).awaitTermination()
    assert spark.read.parquet(out).where("kind = 'snapshot'").count() == 7
    got = I.latest_states(spark, out).select("job_id", "status", "attempts").collect()
    want = J.job_states(log).select("job_id", "status", "attempts").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_timers_tell_silent_jobs_at_each_watermark(spark, tmp_path):
    """Stopped and started again between files; a job that beats again is alive, whatever timer it had."""
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    rng = random.Random(2)
    rows = sorted((rng.randrange(400_000), rng.randrange(60), rng.choice(["view", "view", "click", "error", "purchase", "signup"])) for _ in range(900))
    rows = [(job, t, event, i) for i, (t, job, event) in enumerate(rows)]
    log = spark.createDataFrame(rows, "job_id long, t long, event string, event_id long").select("job_id", F.timestamp_seconds("t").alias("ts"), "event", "event_id")
    for lo, hi in ((0, 300), (300, 310), (310, 700), (700, 900)):
        log.where(f"event_id >= {lo} AND event_id < {hi}").coalesce(1).write.mode("append").parquet(src)
        I.stalled_stream(I.source(spark, src, 1), out, mark, timeout=20_000).awaitTermination()
        seen = log.where(f"event_id < {hi}")
        as_of = seen.agg(F.max("ts")).first()[0]
        want = J.stalled(J.job_states(seen), F.lit(as_of), 20_000).select("job_id", "heartbeat_at", "attempts", "next_status").collect()
        got = I.stalled_now(spark, out).select("job_id", "heartbeat_at", "attempts", "next_status").collect()
        assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))
    I.stalled_stream(I.source(spark, src, 1), out, mark, timeout=20_000).awaitTermination()
    assert sorted(map(tuple, I.stalled_now(spark, out).collect())) == sorted(map(tuple, want))

"""Catalogue, intake and queue queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import answers as A
from docquarry.operators import catalog as C
from docquarry.operators import jobs as J
from docquarry.operators.ranges import row_numbers
from docquarry.plans import model
from docquarry.session import prepare, table

AS_OF = "2024-01-30 12:00:00"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each embedded document."""
    docs = model.documents(spark, sf_dir).select("document_id", "workspace_id")
    return model.vectors(spark, sf_dir).join(docs, "document_id").select("document_id", "workspace_id", "tag")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat turns in the workspace of the document with the conversation's number."""
    docs = model.documents(spark, sf_dir).select(F.col("document_id").alias("conv_id"), "workspace_id")
    return table(spark, sf_dir, "conversations").join(docs, "conv_id")


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = model.documents(spark, sf_dir).join(model.vectors(spark, sf_dir).drop("embedding"), "document_id", "left")
    return C.value_counts(docs, {"topic": F.col("tag"), "entity": F.col("filename"), "type": F.col("status")})


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.status_counts(model.documents(spark, sf_dir))


def workspace_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = model.documents(spark, sf_dir)
    top = C.top_values(_values(spark, sf_dir).where("kind = 'topic'"), 5, ("workspace_id",))
    return C.workspace_cards(docs.select("workspace_id").distinct(), docs, _chunks(spark, sf_dir), _messages(spark, sf_dir), top)


def document_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = C.document_list(model.documents(spark, sf_dir), _chunks(spark, sf_dir))
    return listed.select("document_id", "workspace_id", "filename", "status", "n_chunks")


def corpus_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = C.corpus_state(model.documents(spark, sf_dir))
    return state.select("workspace_id", "n_ready", F.array_join("names", ",").alias("ready_names"), "processing")


def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.top_values(_values(spark, sf_dir), 3, ("workspace_id", "kind"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = C.vocabulary(_values(spark, sf_dir), ("workspace_id", "kind"))
    pairs = F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return v.select("workspace_id", "kind", F.array_join(pairs, ",").alias("counts"))


def spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve distinct words of each whole document, once whatever their case."""
    docs = model.documents(spark, sf_dir)
    return docs.select("document_id", F.array_join(C.distinct_spellings(F.split("content", "[ \n]+")), ",").alias("words"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat history with an explicit number, the two turns of an exchange in order; a conversation may span tasks."""
    turns = table(prepare(spark), sf_dir, "conversations").where("role <> 'system'").select("conv_id", "turn", "role", F.col("text").alias("shown"))
    return row_numbers(turns, ("conv_id",), ("turn",)).select("conv_id", F.col("n").cast("int").alias("n"), "role", "shown")


def session_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that live twelve hours from an event, with their user."""
    sessions = table(prepare(spark), sf_dir, "events").select("event_id", "user_id", (F.col("ts") + F.expr("INTERVAL 12 HOURS")).alias("expires_at"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"))
    return C.live_sessions(sessions, users, F.lit(AS_OF).cast("timestamp")).select("event_id", "user_id", "username")


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.documents(spark, sf_dir).select("document_id", F.sha2("content", 256).alias("file_hash"), F.octet_length("content").alias("size_bytes"))


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exact_duplicates(model.documents(spark, sf_dir)).withColumn("first_id", F.coalesce("first_id", F.lit(-1)))


def version_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = C.version_chain(model.documents(spark, sf_dir))
    return v.withColumn("next_version", C.next_version(F.col("version")))


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cascade_counts(model.documents(spark, sf_dir), _chunks(spark, sf_dir), _messages(spark, sf_dir))


def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary rebuilt after the failed documents and their chunks are deleted, and how many chunks went."""
    docs = model.documents(spark, sf_dir)
    tables = {"documents": docs, "chunks": _chunks(spark, sf_dir).drop("workspace_id")}
    left = C.delete_cascade(tables, docs.where("status = 'failed'"), "document_id")
    kept = left["documents"][0].join(left["chunks"][0], "document_id", "left")
    counts = C.value_counts(kept, {"topic": F.col("tag"), "type": F.col("status")})
    gone = left["chunks"][1].agg(F.count("*").alias("n")).select(F.lit("").alias("workspace_id"), F.lit("deleted").alias("kind"), F.lit("chunks").alias("value"), "n")
    return counts.unionByName(gone)


def delete_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each source after the failed documents are deleted."""
    kept, _ = C.delete_where(model.documents(spark, sf_dir), F.col("status") == "failed")
    return kept.groupBy("filename").agg(F.count("*").alias("n"))


def chunk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of one tag written again with another, and one that is new."""
    have = _chunks(spark, sf_dir)
    again = have.where("tag = 3").withColumn("tag", F.lit(30))
    fresh = again.select((F.col("document_id") + 10_000_000).alias("document_id"), "workspace_id", "tag")
    return C.upsert(have, again.unionByName(fresh), "document_id")


def pending_embedding_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pending_batches(model.documents(spark, sf_dir).select("document_id", "workspace_id"), model.vectors(spark, sf_dir))


def workspace_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each workspace says to a greeting."""
    docs = model.documents(spark, sf_dir)
    state = C.corpus_state(docs)
    best = C.top_values(_values(spark, sf_dir).where("kind = 'topic'"), 8, ("workspace_id",))
    topics = best.groupBy("workspace_id").agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("t")).select("workspace_id", F.col("t.value").alias("topics"))
    both = state.join(topics, "workspace_id", "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))
    return both.select("workspace_id", A.overview(F.lit("greeting"), F.col("names"), F.col("topics"), F.col("processing")).alias("reply"))


def upload_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads of at most 2,000 bytes, of which some have no supported type."""
    docs = model.documents(spark, sf_dir)
    mime = F.when(F.col("document_id") % 4 > 0, "text/plain")
    return docs.select("document_id", F.coalesce(A.reject_reason(F.octet_length("content"), mime, 2000), F.lit("taken")).alias("verdict"), A.question_ok(F.col("content"), F.lit(8)).alias("could_be_question"))


def tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose tags hold a type and two of the words of their whole text."""
    docs = model.documents(spark, sf_dir)
    tags = F.struct(F.col("status").alias("document_type"), F.split(F.lower("content"), "[^a-z]+").alias("topics"))
    return docs.withColumn("tags", tags).where(A.has_tags(F.col("tags"), {"document_type": "ready", "topics": ["the", "and"]})).select("document_id")


def embed_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of hashed term counts for all documents without one: their width, largest part and sum."""
    docs = model.documents(spark, sf_dir).join(model.vectors(spark, sf_dir).select("document_id"), "document_id", "left_anti")
    made = A.embed_texts(docs, "document_id", "content", A.hashing_embedder(64), 64)
    return made.select("document_id", F.size("embedding").alias("width"), F.round(F.array_max("embedding").cast("double"), 4).alias("largest"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.job_states(model.job_log(spark, sf_dir)).select("job_id", "status", "attempts")


def stalled_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.stalled(J.job_states(model.job_log(spark, sf_dir)), F.lit(AS_OF).cast("timestamp")).select("job_id", "attempts", "next_status")


def claim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.claim_order(J.job_states(model.job_log(spark, sf_dir)), 20).select("job_id", "attempts")


def pending_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = J.job_states(model.job_log(spark, sf_dir))
    return states.groupBy("status").agg(F.count("*").alias("n"))


def progress_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each workspace's documents that have a vector, as embedding progress."""
    docs = model.documents(spark, sf_dir).select("document_id", "workspace_id").join(model.vectors(spark, sf_dir).select("document_id", F.lit(1).alias("has")), "document_id", "left")
    per = docs.groupBy("workspace_id").agg(F.count("has").alias("done"), F.count("*").alias("total"))
    return per.select("workspace_id", J.progress(F.col("done"), F.col("total")).alias("pct"))


def retry_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed events as provider replies: code, message, whether to try again, and how long to wait."""
    log = table(prepare(spark), sf_dir, "events").where("event_type = 'error'")
    k = F.get_json_object("props", "$.k").cast("int")
    message = F.when(k % 3 == 0, F.concat(F.lit("Please retry in "), F.col("value").cast("string"), F.lit("s."))).when(k % 3 == 1, F.lit("Service UNAVAILABLE")).otherwise(F.lit("bad request"))
    rows = log.select("event_id", (F.lit(400) + k).alias("code"), message.alias("message"))
    return rows.select("event_id", J.retryable(F.col("code"), F.col("message")).alias("again"), F.coalesce(F.round(J.server_delay(F.col("message")), 4), F.lit(-1.0)).alias("wait"), J.backoff(F.col("event_id") % 8 + 1).alias("local_wait"))


def document_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as documents whose events are changes: a purchase makes one ready, an error fails it, a view tells its pages."""
    log = table(prepare(spark), sf_dir, "events")
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "ready").when(kind == "error", "failed").when(kind == "signup", "pending").otherwise(F.lit("chunking"))
    pages = F.when(kind == "view", F.get_json_object("props", "$.k").cast("int"))
    changes = log.select(F.col("user_id").alias("document_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), status.alias("status"), pages.alias("page_count"), F.concat(F.lit("error "), F.col("event_id").cast("string")).alias("error_message"))
    told = C.status_log(changes)
    return told.select("document_id", "status", F.coalesce("page_count", F.lit(-1)).alias("page_count"), F.coalesce(F.unix_micros("indexed_at"), F.lit(-1)).alias("indexed_at"), F.coalesce("error_message", F.lit("")).alias("error_message"))


def document_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every workspace's documents, newest first."""
    docs = table(prepare(spark), sf_dir, "documents").select(F.col("lang").alias("workspace_id"), F.col("doc_id").alias("document_id"), F.col("source").alias("filename"))
    return C.listing(docs, ["workspace_id"], "document_id", newest_first=True)


def workspace_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workspaces by their first document, oldest first."""
    docs = table(prepare(spark), sf_dir, "documents")
    first = docs.groupBy(F.col("lang").alias("workspace_id")).agg(F.min("doc_id").alias("created"))
    return C.listing(first.withColumn("all", F.lit(0)), ["all"], "created", newest_first=False).drop("all")


def global_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select(F.col("doc_id").alias("document_id"))
    jobs = J.job_states(model.job_log(spark, sf_dir))
    return C.global_counts(jobs, docs, model.vectors(spark, sf_dir), table(spark, sf_dir, "conversations"), table(spark, sf_dir, "customer"))


QUERIES = {f.__name__: f for f in (document_states, document_listing, workspace_listing, global_counts, status_counts, workspace_cards, document_list, corpus_state, top_values, vocabulary, spellings, history, session_join, content_hash, exact_dedup, version_chain, cascade_delete, delete_rows, delete_documents, chunk_upsert, pending_embedding_batches, workspace_replies, upload_guards, tag_filter, embed_pending, job_states, stalled_jobs, claim_order, pending_jobs, progress_pct, retry_rules)}

_WORKING = ", ".join(f"'{s}'" for s in C.WORKING)
_D = f"WITH {model.DOCUMENTS_SQL}"
_C = f"{_D}, chunks AS (SELECT e.vec_id AS document_id, d.workspace_id, e.label AS tag FROM embeddings e JOIN docs d ON e.vec_id = d.document_id)"
_M = f"{_C}, messages AS (SELECT c.*, d.workspace_id FROM conversations c JOIN docs d ON c.conv_id = d.document_id)"
_V = f"""{_M}, vals AS (
  SELECT workspace_id, kind, value, count(*) AS n FROM (
    SELECT workspace_id, 'topic' AS kind, tag::VARCHAR AS value FROM chunks UNION ALL SELECT workspace_id, 'entity', filename FROM docs UNION ALL SELECT workspace_id, 'type', status FROM docs)
  GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY workspace_id, kind ORDER BY n DESC, value) AS rank FROM vals)"""
_COUNTS = f"count(*)::BIGINT AS total, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IN ({_WORKING})) AS in_progress"
_J = """WITH j AS (SELECT user_id AS job_id, max_by(event_type, (ts, event_id)) AS last, max(ts) AS heartbeat_at, min(ts) AS created_at, count(*) FILTER (event_type = 'error') AS attempts FROM events GROUP BY 1),
states AS (SELECT *, CASE last WHEN 'purchase' THEN 'succeeded' WHEN 'signup' THEN 'pending' WHEN 'error' THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END ELSE 'running' END AS status FROM j)"""

_LIST = lambda c, n: f"CASE WHEN len({c}) > {n} THEN array_to_string({c}[1:{n}], ', ') || ', and ' || (len({c}) - {n}) || ' more' WHEN len({c}) > 1 THEN array_to_string({c}[:-2], ', ') || ' and ' || {c}[-1] ELSE {c}[1] END"

ORACLE_SQL = {
    "document_states": """WITH c AS (SELECT user_id AS document_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'ready' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' ELSE 'chunking' END AS status, CASE event_type WHEN 'view' THEN (props->>'$.k')::INT END AS pages FROM events),
l AS (SELECT document_id, arg_max({'status': status, 'ts': ts, 'id': event_id}, (ts, event_id)) AS l, arg_max(pages, (ts, event_id)) FILTER (pages IS NOT NULL) AS pages FROM c GROUP BY 1)
SELECT document_id, l.status AS status, coalesce(pages, -1) AS page_count, CASE WHEN l.status = 'ready' THEN epoch_us(l.ts) ELSE -1 END AS indexed_at, CASE WHEN l.status = 'failed' THEN 'error ' || l.id ELSE '' END AS error_message FROM l""",
    "document_listing": "SELECT lang AS workspace_id, doc_id AS document_id, source AS filename, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS position FROM documents",
    "workspace_listing": "SELECT lang AS workspace_id, min(doc_id) AS created, row_number() OVER (ORDER BY min(doc_id)) AS position FROM documents GROUP BY 1",
    "global_counts": f"{_J} SELECT count(*) FILTER (status = 'pending') AS pending_jobs, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS pending_embeddings, (SELECT count(*) FROM conversations) AS messages, (SELECT count(*) FROM customer) AS users FROM states",
    "status_counts": f"{_D}, s AS (SELECT workspace_id, status, count(*) AS n FROM docs GROUP BY 1, 2), b AS (SELECT workspace_id, string_agg(status || '=' || n, ',' ORDER BY status) AS by_status FROM s GROUP BY 1) SELECT workspace_id, {_COUNTS}, any_value(by_status) AS by_status FROM docs JOIN b USING (workspace_id) GROUP BY 1",
    "workspace_cards": f"""{_V}, c AS (SELECT workspace_id, {_COUNTS} FROM docs GROUP BY 1), k AS (SELECT workspace_id, count(*) AS chunks FROM chunks GROUP BY 1),
q AS (SELECT workspace_id, max(turn) AS last_question FROM messages WHERE role = 'user' GROUP BY 1), t AS (SELECT workspace_id, string_agg(value, ',' ORDER BY rank) AS topics FROM ranked WHERE kind = 'topic' AND rank <= 5 GROUP BY 1)
SELECT c.*, coalesce(chunks, 0)::BIGINT AS chunks, last_question, coalesce(topics, '') AS topics FROM c LEFT JOIN k USING (workspace_id) LEFT JOIN q USING (workspace_id) LEFT JOIN t USING (workspace_id)""",
    "document_list": f"{_C} SELECT document_id, docs.workspace_id, filename, status, count(tag)::BIGINT AS n_chunks FROM docs LEFT JOIN chunks USING (document_id) GROUP BY ALL",
    "corpus_state": f"{_D} SELECT workspace_id, count(*) FILTER (status = 'ready') AS n_ready, coalesce(array_to_string(list_sort(list_distinct(list(filename) FILTER (status = 'ready'))), ','), '') AS ready_names, count(*) FILTER (status IN ({_WORKING})) AS processing FROM docs GROUP BY 1",
    "top_values": f"{_V} SELECT workspace_id, kind, value, n, rank::INT AS rank FROM ranked WHERE rank <= 3",
    "vocabulary": f"{_V} SELECT workspace_id, kind, string_agg(value || '=' || n, ',' ORDER BY value) AS counts FROM vals GROUP BY 1, 2",
    "spellings": r"""WITH w AS (SELECT doc_id AS document_id, unnest(regexp_split_to_array(text, '[ \n]+')) AS v, generate_subscripts(regexp_split_to_array(text, '[ \n]+'), 1) AS i FROM documents),
f AS (SELECT document_id, lower(v) AS l, min_by(v, i) AS v, min(i) AS i FROM w WHERE v <> '' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY i) AS k FROM f)
SELECT document_id, string_agg(v, ',' ORDER BY k) AS words FROM r WHERE k <= 12 GROUP BY 1""",
    "history": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS n, role, text AS shown FROM conversations WHERE role <> 'system'",
    "session_join": f"SELECT event_id, user_id, c_name AS username FROM events JOIN customer ON user_id = c_custkey WHERE ts + INTERVAL 12 HOUR > TIMESTAMP '{AS_OF}'",
    "content_hash": "SELECT doc_id AS document_id, sha256(text) AS file_hash, strlen(text)::INT AS size_bytes FROM documents",
    "exact_dedup": f"{_D}, h AS (SELECT workspace_id, document_id, status, sha256(content) AS file_hash FROM docs), f AS (SELECT workspace_id, file_hash, min(document_id) AS first_id FROM h WHERE status = 'ready' GROUP BY 1, 2) SELECT document_id, file_hash, coalesce(first_id, -1) AS first_id, coalesce(first_id < document_id, false) AS duplicate FROM h LEFT JOIN f USING (workspace_id, file_hash)",
    "version_chain": f"""{_D}, h AS (SELECT *, lag(sha256(content)) OVER w AS before, lead(document_id) OVER w AS later FROM docs WINDOW w AS (PARTITION BY workspace_id, filename ORDER BY document_id)),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> sha256(content) THEN 1 ELSE 0 END) OVER (PARTITION BY workspace_id, filename ORDER BY document_id) AS n FROM h)
SELECT document_id, 'v' || n::BIGINT AS version, later IS NOT NULL AS superseded, 'v' || (n::BIGINT + 1) AS next_version FROM n""",
    "cascade_delete": f"""{_M} SELECT workspace_id, count(*) FILTER (k = 'd') AS documents, count(*) FILTER (k = 'c') AS chunks, count(*) FILTER (k = 'm') AS messages
FROM (SELECT workspace_id, 'd' AS k FROM docs UNION ALL SELECT workspace_id, 'c' FROM chunks UNION ALL SELECT workspace_id, 'm' FROM messages) GROUP BY 1""",
    "delete_rows": f"""{_C}, k AS (SELECT d.workspace_id, d.status, c.tag FROM docs d LEFT JOIN chunks c USING (document_id) WHERE d.status <> 'failed')
SELECT workspace_id, 'topic' AS kind, tag::VARCHAR AS value, count(*) AS n FROM k WHERE tag IS NOT NULL GROUP BY ALL UNION ALL SELECT workspace_id, 'type', status, count(*) FROM k GROUP BY ALL
UNION ALL SELECT '', 'deleted', 'chunks', count(*) FROM chunks JOIN docs USING (document_id) WHERE status = 'failed'""",
    "delete_documents": f"{_D} SELECT filename, count(*) AS n FROM docs WHERE status <> 'failed' GROUP BY 1",
    "chunk_upsert": f"{_C} SELECT document_id, workspace_id, (CASE WHEN tag = 3 THEN 30 ELSE tag END)::INT AS tag FROM chunks UNION ALL SELECT document_id + 10000000, workspace_id, 30 FROM chunks WHERE tag = 3",
    "pending_embedding_batches": f"{_D} SELECT workspace_id, document_id, ((row_number() OVER (PARTITION BY workspace_id ORDER BY document_id) - 1) // 32)::BIGINT AS batch FROM docs WHERE document_id NOT IN (SELECT vec_id FROM embeddings)",
    "workspace_replies": f"""{_V}, r AS (SELECT workspace_id, list_sort(list_distinct(list(filename) FILTER (status = 'ready'))) AS names, count(*) FILTER (status IN ({_WORKING})) AS processing FROM docs GROUP BY 1),
t AS (SELECT workspace_id, list(value ORDER BY rank) AS topics FROM ranked WHERE kind = 'topic' AND rank <= 8 GROUP BY 1),
b AS (SELECT workspace_id, coalesce(names, []) AS names, coalesce(topics, []) AS topics, processing FROM r LEFT JOIN t USING (workspace_id))
SELECT workspace_id, 'Hi. ' || CASE WHEN len(names) = 0 THEN CASE WHEN processing > 0 THEN processing || ' document(s) are in work.' ELSE 'There are no documents yet.' END
ELSE 'This workspace has ' || len(names) || CASE WHEN len(names) = 1 THEN ' document: ' ELSE ' documents: ' END || {_LIST("names", 5)} || '.' || CASE WHEN len(topics) > 0 THEN ' Topics: ' || {_LIST("topics", 6)} || '.' ELSE '' END || CASE WHEN processing > 0 THEN ' In work: ' || processing || '.' ELSE '' END END AS reply FROM b""",
    "upload_guards": "SELECT doc_id AS document_id, CASE WHEN strlen(text) > 2000 THEN 'too large' WHEN strlen(text) = 0 THEN 'empty' WHEN doc_id % 4 = 0 THEN 'unsupported type' ELSE 'taken' END AS verdict, length(trim(text)) BETWEEN 1 AND 4000 AS could_be_question FROM documents",
    "tag_filter": f"{_D} SELECT document_id FROM docs WHERE status = 'ready' AND list_has_all(regexp_split_to_array(lower(content), '[^a-z]+'), ['the', 'and'])",
    "embed_pending": rf"""{_D}, t AS (SELECT document_id, unnest(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]+')) AS term FROM docs WHERE document_id NOT IN (SELECT vec_id FROM embeddings)),
c AS (SELECT document_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS slot, count(*)::DOUBLE AS n FROM t GROUP BY 1, 2),
v AS (SELECT document_id, max(n) / sqrt(sum(n * n)) AS largest, sum(n) / sqrt(sum(n * n)) AS total FROM c GROUP BY 1)
SELECT document_id, 64 AS width, round(coalesce(largest, 0), 4) AS largest, round(coalesce(total, 0), 3) AS total FROM docs LEFT JOIN v USING (document_id) WHERE document_id NOT IN (SELECT vec_id FROM embeddings)""",
    "job_states": f"{_J} SELECT job_id, status, attempts FROM states",
    "stalled_jobs": f"{_J} SELECT job_id, attempts, CASE WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END AS next_status FROM states WHERE status = 'running' AND heartbeat_at < TIMESTAMP '{AS_OF}' - INTERVAL 3600 SECOND",
    "claim_order": f"{_J} SELECT job_id, attempts + 1 AS attempts FROM states WHERE status = 'pending' ORDER BY created_at, job_id LIMIT 20",
    "pending_jobs": f"{_J} SELECT status, count(*) AS n FROM states GROUP BY 1",
    "progress_pct": f"{_D} SELECT workspace_id, (50 + floor(count(vec_id) * 50.0::DOUBLE / count(*)))::INT AS pct FROM docs LEFT JOIN embeddings ON document_id = vec_id GROUP BY 1",
    "retry_rules": """WITH k AS (SELECT event_id, value, (props->>'$.k')::INT AS k FROM events WHERE event_type = 'error')
SELECT event_id, k + 400 IN (408, 429, 500, 502, 503, 504) OR k % 3 = 1 AS again, CASE WHEN k % 3 = 0 THEN round(least(value, 65.0::DOUBLE), 4) ELSE -1.0::DOUBLE END AS wait, least(pow(2.0::DOUBLE, event_id % 8), 60.0::DOUBLE) AS local_wait FROM k""",
}

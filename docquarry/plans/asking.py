"""Questions over passages, cited sources and upload decisions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import answers as A
from docquarry.operators import catalog as C
from docquarry.operators import enrich as E
from docquarry.operators import flow as W
from docquarry.operators import intake as I
from docquarry.operators import jobs as J
from docquarry.operators import questions as Q
from docquarry.operators import retrieval as R
from docquarry.plans import model, search, tenancy
from docquarry.session import prepare, table

QUESTION = 'the attion tion or "anea eriner" -onwh'
SHORT = "the onening of tions"
MOST_BYTES = 2000


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with text is a passage of its document."""
    docs = model.documents(spark, sf_dir).withColumn("header", F.concat_ws(" > ", "filename", "workspace_id"))
    return docs.select("workspace_id", "document_id", "filename", "status", "header", F.posexplode(F.split("content", "\n")).alias("ordinal", "content")).where("content <> ''")


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages; the first of a document has its vector."""
    rows = _lines(spark, sf_dir).join(model.vectors(spark, sf_dir).withColumn("ordinal", F.lit(0)), ["document_id", "ordinal"], "left")
    return rows.withColumns({"section": F.col("workspace_id"), "tags": F.struct(F.col("status").alias("document_type"), F.col("tag").alias("topic"))})


def search_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 32 documents that answer a typed question best."""
    docs = model.documents(spark, sf_dir).withColumn("header", F.concat_ws(" > ", "filename", "workspace_id"))
    return Q.question_pool(docs, QUESTION, 32, ("document_id",)).select("document_id", "text_rank", F.round("text_score", 6).alias("text_score"))


def search_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best passages for a question and its vector, over all ready documents."""
    best = Q.search_chunks(_passages(spark, sf_dir), SHORT, search._query(spark, sf_dir), 8)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return best.select("document_id", "ordinal", "filename", "header", F.col("tags.document_type").alias("document_type"), F.round("score", 5).alias("score"), zero("vec_rank"), zero("text_rank"), "snippet")


def ask_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the answer to a question in one workspace cites, from a reply that names sources 3, 1 and one that isn't there."""
    states = C.corpus_state(model.documents(spark, sf_dir)).withColumn("topics", F.array().cast("array<string>"))
    messages = table(spark, sf_dir, "conversations").select(F.lit("en").alias("workspace_id"), F.col("conv_id").alias("user_id"), "turn", "role", F.col("text").alias("content"))
    vector = search._query(spark, sf_dir)
    done = W.ask(_passages(spark, sf_dir), states, messages, "en", 1, SHORT, lambda _: vector, lambda _: "As [3] and [1] say, and [40] and [3].")
    return done.cited.select("rank", "number", "document_id", "ordinal", "filename", F.round("score", 5).alias("score"), "snippet")


def _newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(workspace_id, rank, document_id, filename) of each workspace's eight newest ready documents."""
    docs = model.documents(spark, sf_dir).where("status = 'ready'").select("workspace_id", "document_id", "filename")
    order = F.row_number().over(R.Window.partitionBy("workspace_id").orderBy(F.desc("document_id")))
    return docs.withColumn("rank", order).where("rank <= 8")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the chat log in the workspace of the document with the conversation's number."""
    docs = model.documents(spark, sf_dir).select(F.col("document_id").alias("conv_id"), "workspace_id")
    return search._answers(spark, sf_dir).join(docs, "conv_id")


def cited_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each citation of the chat log with the document that it names."""
    cited = R.citations(_asked(spark, sf_dir), "answer", "n_results", ("workspace_id", "conv_id", "turn"))
    return R.cited_sources(cited, _newest(spark, sf_dir), ("workspace_id",)).select("conv_id", "turn", "rank", "number", "document_id", "filename")


def answers_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's reply, or the refusal where its workspace has no ready document of an even number or the reply is empty."""
    asked = _asked(spark, sf_dir).select("workspace_id", "conv_id", "turn", F.when(F.col("turn") % 3 > 0, F.col("answer")).alias("reply"))
    results = asked.select("workspace_id", "conv_id", "turn").join(_newest(spark, sf_dir).where("document_id % 2 = 0").select("workspace_id", "rank"), "workspace_id")
    return R.answer(results, asked, ("conv_id", "turn"), "Not found.")


def _uploads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All documents as uploads, and a catalogue of the first document of every file name."""
    docs = table(prepare(spark), sf_dir, "documents", spread=True).select(F.col("doc_id").alias("document_id"), F.col("lang").alias("workspace_id"), F.col("source").alias("filename"), F.col("text").cast("binary").alias("content"))
    first = docs.groupBy("workspace_id", "filename").agg(F.min(F.struct("document_id", F.sha2("content", 256).alias("file_hash"))).alias("d"))
    # only digests meet the labels
    status = model.statuses(table(spark, sf_dir, "labels"))
    catalogue = first.select("workspace_id", "filename", "d.*").join(status, "document_id", "left").select("workspace_id", "document_id", "filename", "file_hash", F.coalesce("status", F.lit("pending")).alias("status"), F.lit("v4").alias("version"))
    uploads = docs.select(F.col("document_id").alias("upload_id"), "workspace_id", "filename", "content", F.when(F.col("document_id") % 9 > 0, "text/plain").alias("mime_type"))
    return uploads, catalogue


def intake_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every upload decided against the catalogue as it is."""
    return _decided(I.decide(*_uploads(spark, sf_dir), MOST_BYTES))


def intake_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every upload decided once those before it have taken effect."""
    return _decided(I.decide_in_order(*_uploads(spark, sf_dir), MOST_BYTES))


def _decided(out: DataFrame) -> DataFrame:
    return out.select("upload_id", "decision", F.coalesce("document_id", F.lit(-1)).alias("document_id"), F.coalesce("version", F.lit("")).alias("version"), F.coalesce("reason", F.lit("")).alias("reason"))


def retry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed events as errors of a client: whether to try again, whether it is the quota, how long to wait, and when a person waits."""
    log = table(prepare(spark), sf_dir, "events").where("event_type = 'error'")
    k = F.get_json_object("props", "$.k").cast("int")
    message = F.when(k % 4 == 0, F.concat(F.lit("retryDelay: '"), F.round("value", 2).cast("string"), F.lit("s'"))).when(k % 4 == 1, F.lit("RESOURCE_EXHAUSTED")).otherwise(F.lit("quota project unset"))
    types = F.array(F.when(k % 5 == 0, "ReadTimeout").otherwise(F.lit("ValueError")), F.lit("Exception"))
    rows = log.select("event_id", (F.lit(420) + k).alias("code"), message.alias("message"), types.alias("types"))
    attempt, chance = F.col("event_id") % 5 + 1, (F.col("event_id") % 10) / 10
    server = J.server_delay(F.col("message"))
    wait = lambda interactive: F.coalesce(F.round(J.retry_wait(attempt, server, chance, interactive), 4), F.lit(-1.0))
    return rows.select("event_id", J.retryable(F.col("code"), F.col("message"), F.col("types")).alias("again"), J.rate_limited(F.col("code"), F.col("message")).alias("quota"), wait(False).alias("wait"), wait(True).alias("interactive_wait"))


def name_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who want their market segment, or a workspace's language, as a name that another has."""
    wanted = table(prepare(spark), sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "EN ").otherwise(F.concat("c_mktsegment", F.floor(F.col("c_custkey") / 2).cast("string"))).alias("slug"))
    taken = model.documents(spark, sf_dir).select(F.col("workspace_id").alias("slug")).distinct()
    return I.clashes(wanted, taken, "slug")


def admin_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live sessions that may change a workspace: those of users with a positive balance."""
    sessions = table(prepare(spark), sf_dir, "events").select("event_id", "user_id", (F.col("ts") + F.expr("INTERVAL 12 HOURS")).alias("expires_at"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_acctbal") > 0, "admin").otherwise(F.lit("reader")).alias("role"))
    return sessions.join(users, "user_id").where(A.may_act(F.col("role"), F.lit("upload"))).select("event_id", "user_id")


def section_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat turns as chunks, two a section, under headers with what is said of their section: the begin of its first chunk."""
    chats = table(prepare(spark), sf_dir, "conversations")
    section = F.floor(F.col("turn") / 2).cast("string")
    chunks = chats.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), F.concat(F.lit("chat "), F.col("conv_id").cast("string")).alias("document"), section.alias("section"), F.array(section).alias("path"), F.col("text").alias("content"))
    return E.contextualise(chunks, lambda texts: [t or "" for t in texts]).select("doc_id", "ordinal", "header")


def document_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles from replies in fences, of which every fifth is broken."""
    docs = model.documents(spark, sf_dir)
    said = F.to_json(F.struct(F.col("status").alias("document_type"), F.filter(F.split("content", "[ \n]+"), lambda w: w != "").alias("topics")))
    reply = F.when(F.col("document_id") % 5 == 0, F.concat(F.lit("Sorry {"), said)).otherwise(F.concat(F.lit("Here:\n```json\n"), said, F.lit("\n```")))
    p = docs.select("document_id", E.profile(reply).alias("p"))
    return p.select("document_id", "p.document_type", F.array_join("p.topics", ",").alias("topics"), F.size("p.entities").alias("n_entities"))


def chat_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a message, some as small talk, with what a workspace says to it."""
    docs = model.documents(spark, sf_dir)
    states = C.corpus_state(docs).select("workspace_id", "names", F.array().cast("array<string>").alias("topics"), "processing")
    said = F.when(F.col("turn") % 5 == 0, "Hello there!").when(F.col("turn") % 5 == 1, "thanks a lot.").otherwise(F.col("text"))
    turns = table(spark, sf_dir, "conversations").join(docs.select(F.col("document_id").alias("conv_id"), "workspace_id"), "conv_id").select("workspace_id", "conv_id", "turn", said.alias("text"))
    return A.route(turns, states).select("conv_id", "turn", "route", F.coalesce("reply", F.lit("")).alias("reply"))


def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent of every job: its last event is its stage, its clicks are what is embedded of all its events."""
    log = model.job_log(spark, sf_dir)
    per = log.groupBy("job_id").agg(F.max_by("event", F.struct("ts", "event_id")).alias("last"), F.count(F.when(F.col("event") == "click", 1)).alias("done"), F.count("*").alias("total"))
    stage = F.when(F.col("last") == "signup", "parse").when(F.col("last") == "view", "chunk").when(F.col("last") == "click", "embed").when(F.col("last") == "purchase", "done").otherwise(F.lit("failed"))
    return per.select("job_id", J.stage_progress(stage, F.col("done"), F.col("total")).alias("pct"))


def saved_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats of even turns, with the odd ones asked again as exchanges after them."""
    chats = table(prepare(spark), sf_dir, "conversations")
    messages = chats.where("turn % 2 = 0").select(F.lit("w").alias("workspace_id"), F.col("conv_id").alias("user_id"), "turn", "role", F.col("text").alias("content"))
    exchanges = chats.where("turn % 2 = 1").select(F.lit("w").alias("workspace_id"), F.col("conv_id").alias("user_id"), F.col("turn").alias("seq"), F.col("role").alias("question"), F.col("text").alias("answer"))
    return A.save_exchanges(messages, exchanges).select("user_id", "turn", "role", "content")


QUERIES = {f.__name__: f for f in (search_question, search_chunks, ask_question, cited_sources, answers_assembled, intake_decisions, intake_batch, retry_plan, name_clashes, admin_sessions, section_headers, document_profiles, chat_routes, job_progress, saved_exchanges)}


def _scores_sql(source: str, key: str, question: str) -> str:
    """CTEs from ``source`` (key, h, b: term lists of header and body) to ``scored`` (key, s)."""
    stem = lambda c: f"regexp_replace({c}, '{Q.STEM}', '\\1')"
    ctes = [
        f"""w AS (SELECT {key}, i - len(h) AS pos, {stem("h[i + 1]")} AS s, {R.HEADER_WEIGHT}::DOUBLE AS weight FROM (SELECT *, unnest(range(0, len(h))) AS i FROM {source})
  UNION ALL SELECT {key}, i + 1, {stem("b[i + 1]")}, {R.BODY_WEIGHT}::DOUBLE FROM (SELECT *, unnest(range(0, len(b))) AS i FROM {source}))"""
    ]
    keys = key.split(", ")

    def hits(literal: tuple[str, ...], number: int) -> str:
        joins = " ".join(f"JOIN w w{k} ON {' AND '.join(f'w{k}.{c} = w0.{c}' for c in keys)} AND w{k}.pos = w0.pos + {k} AND w{k}.s = '{s}'" for k, s in enumerate(literal) if k)
        return f"SELECT {', '.join(f'w0.{c}' for c in keys)}, {number} AS literal, w0.pos AS lo, w0.pos + {len(literal) - 1} AS hi, w0.weight FROM w w0 {joins} WHERE w0.s = '{literal[0]}'"

    parts = []
    for a, want in enumerate(Q.parse(question)):
        n = len(want.must)
        ctes.append(f"hits{a} AS ({' UNION ALL '.join(hits(x, k) for k, x in enumerate(want.must))})")
        banned = " UNION ALL ".join(hits(x, -1) for x in want.must_not)
        ctes.append(f"ok{a} AS (SELECT * FROM hits{a}" + (f" ANTI JOIN ({banned}) USING ({key})" if banned else "") + ")")
        last = ", ".join(f"last_value(CASE WHEN literal = {k} THEN lo END IGNORE NULLS) OVER v AS l{k}, last_value(CASE WHEN literal = {k} THEN weight END IGNORE NULLS) OVER v AS x{k}" for k in range(n))
        ctes.append(f"spans{a} AS (SELECT {key}, hi, {last} FROM ok{a} WINDOW v AS (PARTITION BY {key} ORDER BY hi, lo, literal ROWS UNBOUNDED PRECEDING))")
        least = f"least({', '.join(f'l{k}' for k in range(n))})" if n > 1 else "l0"
        ctes.append(f"least{a} AS (SELECT {key}, {least} AS lo, min({{'hi': hi, 'w': {n} / ({' + '.join(f'1 / x{k}' for k in range(n))})}}) AS e FROM spans{a} WHERE {' AND '.join(f'l{k} IS NOT NULL' for k in range(n))} GROUP BY ALL)")
        parts.append(f"SELECT {key}, sum(e.w / (1 + greatest(0, e.hi - lo + 1 - {sum(map(len, want.must))}))) AS s FROM least{a} GROUP BY ALL")
    ctes.append(f"scored AS (SELECT {key}, round(sum(s), 9) AS s FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL)")
    return ",\n".join(ctes)


_DOCS = f"WITH {model.DOCUMENTS_SQL}"
_TERMS = search._TERMS_SQL
_NEWEST = "best AS (SELECT workspace_id, document_id, filename, row_number() OVER (PARTITION BY workspace_id ORDER BY document_id DESC) AS rank FROM docs WHERE status = 'ready')"
_JITTER = "(0.5::DOUBLE + {} * (event_id % 10) / 10)"

ORACLE_SQL = {
    "search_question": f"""{_DOCS}, tok AS (SELECT document_id, {_TERMS("concat_ws(' > ', filename, workspace_id)")} AS h, {_TERMS("content")} AS b FROM docs),
{_scores_sql("tok", "document_id", QUESTION)}
SELECT document_id, row_number() OVER (ORDER BY s DESC, document_id)::INT AS text_rank, round(s, 6) AS text_score FROM scored ORDER BY text_rank LIMIT 32""",
    "search_chunks": f"""{_DOCS}, lines AS (SELECT *, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS ordinal FROM docs WHERE status = 'ready'),
ch AS (SELECT document_id, ordinal, filename, status, concat_ws(' > ', filename, workspace_id) AS header, line, embedding FROM lines LEFT JOIN embeddings ON vec_id = document_id AND ordinal = 0 WHERE line <> ''),
tok AS (SELECT document_id, ordinal, {_TERMS("header")} AS h, {_TERMS("line")} AS b FROM ch),
{_scores_sql("tok", "document_id, ordinal", SHORT)},
txt AS (SELECT document_id, ordinal, row_number() OVER (ORDER BY s DESC, document_id, ordinal) AS text_rank FROM scored ORDER BY text_rank LIMIT 32),
q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = {search.QUERY_VECTOR_ID}),
vec AS (SELECT document_id, ordinal, row_number() OVER (ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT v FROM q)), document_id, ordinal) AS vec_rank FROM ch WHERE embedding IS NOT NULL ORDER BY vec_rank LIMIT 32),
fused AS (SELECT document_id, ordinal, vec_rank, text_rank, coalesce(1.0::DOUBLE / (60 + vec_rank), 0) + coalesce(1.0::DOUBLE / (60 + text_rank), 0) AS score FROM vec FULL JOIN txt USING (document_id, ordinal) ORDER BY score DESC, ordinal, document_id LIMIT 8)
SELECT document_id, ordinal::INT AS ordinal, filename, header, status AS document_type, round(score, 5) AS score, coalesce(vec_rank, 0)::INT AS vec_rank, coalesce(text_rank, 0)::INT AS text_rank, left(line, 400) AS snippet FROM fused JOIN ch USING (document_id, ordinal)""",
    "cited_sources": rf"""{_DOCS}, {_NEWEST}, {search._ANSWERS},
n AS (SELECT conv_id, turn, n_results, unnest(regexp_extract_all(answer, '\[(\d{{1,2}})\]', 1))::INT AS number, generate_subscripts(regexp_extract_all(answer, '\[(\d{{1,2}})\]', 1), 1) AS i FROM a),
f AS (SELECT conv_id, turn, number, min(i) AS i FROM n WHERE number BETWEEN 1 AND n_results GROUP BY ALL),
c AS (SELECT f.*, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1)::INT AS rank FROM f)
SELECT conv_id, turn, c.rank, number, best.document_id, best.filename FROM c JOIN docs d ON d.document_id = conv_id JOIN best ON best.workspace_id = d.workspace_id AND best.rank = number AND best.rank <= 8""",
    "answers_assembled": f"""{_DOCS}, {_NEWEST}, {search._ANSWERS},
r AS (SELECT conv_id, turn, CASE WHEN turn % 3 > 0 THEN answer END AS reply, (SELECT count(*) FROM best WHERE best.workspace_id = d.workspace_id AND rank <= 8 AND best.document_id % 2 = 0) AS n FROM a JOIN docs d ON d.document_id = conv_id),
s AS (SELECT *, n = 0 OR trim(coalesce(reply, '')) = '' OR contains(lower(reply), 'not in the documents') AS refused FROM r)
SELECT conv_id, turn, CASE WHEN refused THEN 'Not found.' ELSE trim(reply) END AS text, refused FROM s""",
    "intake_decisions": f"""{_DOCS}, h AS (SELECT *, sha256(content) AS file_hash FROM docs),
cat AS (SELECT workspace_id, filename, min(document_id) AS document_id FROM h GROUP BY 1, 2),
c AS (SELECT h.workspace_id, h.filename, h.document_id, h.file_hash, h.status FROM cat JOIN h USING (document_id)),
same AS (SELECT workspace_id, file_hash, bool_or(status = 'ready') AS ready, coalesce(min(document_id) FILTER (status = 'ready'), min(document_id)) AS document_id FROM c GROUP BY 1, 2),
u AS (SELECT h.document_id AS upload_id, CASE WHEN strlen(content) > {MOST_BYTES} THEN 'too large' WHEN strlen(content) = 0 THEN 'empty' WHEN h.document_id % 9 = 0 THEN 'unsupported type' END AS reason, ready, same.document_id AS same_id, c.document_id AS named_id
  FROM h LEFT JOIN same USING (workspace_id, file_hash) LEFT JOIN c USING (workspace_id, filename)),
d AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN ready THEN 'deduplicated' WHEN same_id IS NOT NULL THEN 'requeued' WHEN named_id IS NOT NULL THEN 'new_version' ELSE 'new' END AS decision FROM u)
SELECT upload_id, decision, CASE decision WHEN 'rejected' THEN -1 WHEN 'new_version' THEN named_id WHEN 'new' THEN upload_id ELSE same_id END AS document_id,
  CASE decision WHEN 'rejected' THEN '' WHEN 'new_version' THEN 'v5' WHEN 'new' THEN 'v1' ELSE 'v4' END AS version, coalesce(reason, '') AS reason FROM d""",
    "retry_plan": f"""WITH k AS (SELECT event_id, round(value, 2) AS value, (props->>'$.k')::INT AS k FROM events WHERE event_type = 'error'),
w AS (SELECT *, CASE WHEN k % 4 = 0 THEN least(value, 65.0::DOUBLE) + {_JITTER.format("1.5::DOUBLE")} ELSE least(pow(2.0::DOUBLE, event_id % 5), 60.0::DOUBLE) * {_JITTER.format("1.0::DOUBLE")} END AS wait FROM k)
SELECT event_id, k + 420 IN (408, 429, 500, 502, 503, 504) OR k % 5 = 0 OR k % 4 = 1 AS again, k + 420 = 429 OR k % 4 = 1 AS quota, round(wait, 4) AS wait, CASE WHEN wait <= 8 THEN round(wait, 4) ELSE -1.0::DOUBLE END AS interactive_wait FROM w""",
    "name_clashes": """WITH w AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'EN ' ELSE c_mktsegment || (c_custkey // 2) END AS slug FROM customer)
SELECT id, slug FROM w WHERE lower(trim(slug)) IN (SELECT lang FROM documents) OR id > (SELECT min(id) FROM w x WHERE lower(trim(x.slug)) = lower(trim(w.slug)))""",
    "section_headers": """WITH s AS (SELECT conv_id, turn // 2 AS section, trim(left(trim(min_by(text, turn)), 200)) AS d FROM conversations GROUP BY 1, 2)
SELECT c.conv_id AS doc_id, turn AS ordinal, 'chat ' || c.conv_id || ' > ' || section || CASE WHEN d <> '' THEN ' - ' || d ELSE '' END AS header FROM conversations c JOIN s ON s.conv_id = c.conv_id AND s.section = turn // 2""",
    "document_profiles": rf"""{_DOCS}, w AS (SELECT document_id, unnest(regexp_split_to_array(content, '[ \n]+')) AS v, generate_subscripts(regexp_split_to_array(content, '[ \n]+'), 1) AS i FROM docs WHERE document_id % 5 > 0),
f AS (SELECT document_id, lower(v) AS l, min_by(v, i) AS v, min(i) AS i FROM w WHERE v <> '' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY i) AS k FROM f),
t AS (SELECT document_id, string_agg(v, ',' ORDER BY k) AS topics FROM r WHERE k <= 12 GROUP BY 1)
SELECT document_id, CASE WHEN document_id % 5 = 0 THEN '' ELSE status END AS document_type, coalesce(topics, '') AS topics, 0 AS n_entities FROM docs LEFT JOIN t USING (document_id)""",
    "chat_routes": f"""{_DOCS}, r AS (SELECT workspace_id, list_sort(list_distinct(list(filename) FILTER (status = 'ready'))) AS names, count(*) FILTER (status IN ({tenancy._WORKING})) AS processing FROM docs GROUP BY 1),
o AS (SELECT workspace_id, 'Hi. ' || CASE WHEN len(coalesce(names, [])) = 0 THEN CASE WHEN processing > 0 THEN processing || ' document(s) are in work.' ELSE 'There are no documents yet.' END
  ELSE 'This workspace has ' || len(names) || CASE WHEN len(names) = 1 THEN ' document: ' ELSE ' documents: ' END || {tenancy._LIST("names", 5)} || '.' || CASE WHEN processing > 0 THEN ' In work: ' || processing || '.' ELSE '' END END AS hello FROM r)
SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'greeting' WHEN 1 THEN 'thanks' ELSE 'question' END AS route, CASE turn % 5 WHEN 0 THEN hello WHEN 1 THEN 'You''re welcome.' ELSE '' END AS reply
FROM conversations JOIN docs ON document_id = conv_id JOIN o USING (workspace_id)""",
    "job_progress": """WITH j AS (SELECT user_id AS job_id, max_by(event_type, (ts, event_id)) AS last, count(*) FILTER (event_type = 'click') AS done, count(*) AS total FROM events GROUP BY 1)
SELECT job_id, CASE last WHEN 'signup' THEN 10 WHEN 'view' THEN 40 WHEN 'click' THEN (50 + floor(done * 50.0::DOUBLE / total))::INT WHEN 'purchase' THEN 100 ELSE 0 END AS pct FROM j""",
    "saved_exchanges": """WITH e AS (SELECT conv_id, turn, role, text FROM conversations WHERE turn % 2 = 0),
o AS (SELECT c.conv_id, role, text, coalesce((SELECT max(turn) + 1 FROM e WHERE e.conv_id = c.conv_id), 0) + (row_number() OVER (PARTITION BY c.conv_id ORDER BY turn) - 1) * 2 AS t FROM conversations c WHERE turn % 2 = 1)
SELECT conv_id AS user_id, turn, role, text AS content FROM e UNION ALL SELECT conv_id, t, 'user', role FROM o UNION ALL SELECT conv_id, t + 1, 'assistant', text FROM o""",
    "admin_sessions": "SELECT event_id, user_id FROM events JOIN customer ON user_id = c_custkey WHERE c_acctbal > 0",
}

# the same search in one workspace, its third and first result
_FOUND = ORACLE_SQL["search_chunks"].replace("WHERE status = 'ready')", "WHERE status = 'ready' AND workspace_id = 'en')", 1)
ORACLE_SQL["ask_question"] = f"""WITH f AS ({_FOUND}), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, ordinal, document_id) AS number FROM f)
SELECT CASE number WHEN 3 THEN 0 ELSE 1 END::INT AS rank, number::INT AS number, document_id, ordinal, filename, score, snippet FROM r WHERE number IN (1, 3)"""

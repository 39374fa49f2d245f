"""Retrieval queries over documents and embeddings, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import ann as A
from docquarry.operators import retrieval as R
from docquarry.plans import model
from docquarry.session import prepare, scratch_folder, table

QUERY_VECTOR_ID = 7
TERMS = ("the", "and")
K = 8


def _query(spark: SparkSession, sf_dir: str) -> list[float]:
    """The question's vector: one row, as an embedder would give it."""
    return list(model.vectors(spark, sf_dir).where(F.col("document_id") == QUERY_VECTOR_ID).first()["embedding"])


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.documents(spark, sf_dir).withColumn("header", F.concat_ws(" > ", "filename", "workspace_id"))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = R.vector_pool(model.vectors(spark, sf_dir), _query(spark, sf_dir), 20)
    return pool.select("document_id", "vec_rank", F.round("distance", 6).alias("distance"))


def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id divides by 50."""
    vectors = model.vectors(spark, sf_dir)
    queries = vectors.where(F.col("document_id") % 50 == 0).select(F.col("document_id").alias("query_id"), "embedding")
    found = R.nearest(queries, vectors, 10)
    return found.select("query_id", "document_id", "rank", F.abs(F.round("distance", 6)).alias("distance"))


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame, DataFrame]:
    """An index of all vectors, the vectors, and those whose id divides by 50 as questions."""
    vectors = model.vectors(spark, sf_dir)
    path = scratch_folder(spark, "ann")
    A.build_index(vectors, path)
    return path, vectors, vectors.where(F.col("document_id") % 50 == 0).select(F.col("document_id").alias("query_id"), "embedding")


def vector_topk_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About the ten nearest vectors of every vector whose id divides by 50, by an index of all."""
    path, vectors, queries = _indexed(spark, sf_dir)
    return A.search(path, queries, vectors, 10).select("query_id", "document_id", "rank", F.abs(F.round("distance", 6)).alias("distance"))


def vector_ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the ten nearest vectors of each question its index finds, and the share of all vectors in the cells that it reads."""
    path, vectors, queries = _indexed(spark, sf_dir)
    made = A.read_model(spark, path)
    true, found = R.nearest(queries, vectors, 10), A.search(path, queries, vectors, 10)
    hits = true.join(found.select("query_id", "document_id", F.lit(1).alias("hit")), ["query_id", "document_id"], "left").groupBy("query_id").agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found"))
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("cell").agg(F.sum(F.size("ids")).alias("rows"))
    read = A._routed(queries, made, made.probes).join(F.broadcast(sizes), "cell").groupBy("query_id").agg(F.sum("rows").alias("rows_read"))
    return hits.join(read, "query_id")


def text_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = R.text_pool(_docs(spark, sf_dir), TERMS, R.pool_size(K))
    return pool.select("document_id", "text_rank", F.round("text_score", 6).alias("text_score"))


def text_phrase_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = R.text_pool(_docs(spark, sf_dir), ("of",), 20, must_not=("src3",), phrases=("of the",))
    return pool.select("document_id", "text_rank", F.round("text_score", 6).alias("text_score"))


def _shown(best: DataFrame) -> DataFrame:
    """Rank 0 stands for a pool that a document wasn't in."""
    return best.select("document_id", "filename", "score", F.coalesce("vec_rank", F.lit(0)).alias("vec_rank"), F.coalesce("text_rank", F.lit(0)).alias("text_rank"), "snippet")


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(R.hybrid_search(_docs(spark, sf_dir), model.vectors(spark, sf_dir), _query(spark, sf_dir), TERMS, K))


def hybrid_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    where, tags = F.col("workspace_id") == "en", F.col("tag").isin(1, 2, 3)
    return _shown(R.hybrid_search(_docs(spark, sf_dir), model.vectors(spark, sf_dir), _query(spark, sf_dir), TERMS, K, where, tags))


def text_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.hybrid_search(_docs(spark, sf_dir), model.vectors(spark, sf_dir), None, TERMS, K).select("document_id", "score", "text_rank")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of the chat log with marks of the sources that they cite, made from their own turns."""
    chats = table(prepare(spark), sf_dir, "conversations").where("role = 'assistant'")
    n = F.col("turn").cast("string")
    return chats.select("conv_id", "turn", F.concat(F.lit("["), n, F.lit("] "), "text", F.lit(" [3]["), n, F.lit("] [12]")).alias("answer"), (F.col("turn") + 2).cast("int").alias("n_results"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.citations(_answers(spark, sf_dir), "answer", "n_results", ("conv_id", "turn"))


def sources_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered sources of each workspace's eight newest documents, with whole texts."""
    docs = _docs(spark, sf_dir).where("status = 'ready'")
    order = F.row_number().over(R.Window.partitionBy("workspace_id").orderBy(F.desc("document_id")))
    return R.source_list(docs.withColumn("rank", order).where("rank <= 8").withColumn("section", F.lit("")), ("workspace_id",))


def message_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole chat turn by kind."""
    chats = table(prepare(spark), sf_dir, "conversations")
    return chats.select("conv_id", "turn", F.coalesce(R.message_kind(F.col("text")), F.lit("question")).alias("kind"))


def answer_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _answers(spark, sf_dir)
    return rows.select("conv_id", "turn", R.answer_state(F.col("answer"), F.col("n_results") - 3).alias("refused"))


def lenient_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k of each event's properties, found inside a reply with a fence or words around it."""
    log = table(prepare(spark), sf_dir, "events")
    even = F.col("event_id") % 2 == 0
    raw = F.when(even, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("Here it is: "), "props", F.lit(" - done")))
    return log.select("event_id", R.lenient_object(raw, "k long")["k"].alias("k"))


QUERIES = {f.__name__: f for f in (vector_topk, vector_topk_batch, vector_topk_ann, vector_ann_recall, text_topk, text_phrase_topk, hybrid_rrf, hybrid_filtered, text_only, citations, sources_list, message_kinds, answer_states, lenient_json)}

_TERMS_SQL = lambda c: f"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
_BASE = f"""WITH {model.DOCUMENTS_SQL},
q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = {QUERY_VECTOR_ID}),
tok AS (SELECT *, concat_ws(' > ', filename, workspace_id) AS header, {_TERMS_SQL("concat_ws(' > ', filename, workspace_id)")} AS h, {_TERMS_SQL("content")} AS b FROM docs)"""
_DISTANCE = "1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT v FROM q))"


def _tf(term: str) -> str:
    return f"(len(list_filter(h, lambda t: t = '{term}')) + 0.4::DOUBLE * len(list_filter(b, lambda t: t = '{term}')))"


_MUST = " AND ".join(f"(list_contains(h, '{t}') OR list_contains(b, '{t}'))" for t in TERMS)
_SCORE = " + ".join(_tf(t) for t in TERMS)


def _hybrid_sql(where: str, tags: str, columns: str, vector: bool = True) -> str:
    pool = R.pool_size(K)
    return f"""{_BASE},
ok AS (SELECT * FROM tok WHERE status = 'ready' AND {where}{f" AND document_id IN (SELECT vec_id FROM embeddings WHERE {tags})" if tags else ""}),
vec AS (SELECT vec_id AS document_id, row_number() OVER (ORDER BY {_DISTANCE}, vec_id) AS vec_rank FROM embeddings WHERE vec_id IN (SELECT document_id FROM ok) AND {tags or "true"} AND {"true" if vector else "false"} ORDER BY vec_rank LIMIT {pool}),
txt AS (SELECT document_id, row_number() OVER (ORDER BY {_SCORE} DESC, document_id) AS text_rank FROM ok WHERE {_MUST} ORDER BY text_rank LIMIT {pool}),
best AS (
  SELECT coalesce(vec.document_id, txt.document_id) AS document_id, vec_rank, text_rank,
    coalesce(1.0::DOUBLE / (60 + vec_rank), 0) + coalesce(1.0::DOUBLE / (60 + text_rank), 0) AS score
  FROM vec FULL JOIN txt ON vec.document_id = txt.document_id ORDER BY score DESC, 1 LIMIT {K})
SELECT {columns} FROM best JOIN docs USING (document_id)"""


_COLUMNS = "document_id, filename, round(score, 5) AS score, coalesce(vec_rank, 0)::INT AS vec_rank, coalesce(text_rank, 0)::INT AS text_rank, left(content, 400) AS snippet"
_ANSWERS = "a AS (SELECT conv_id, turn, '[' || turn || '] ' || text || ' [3][' || turn || '] [12]' AS answer, (turn + 2)::INT AS n_results FROM conversations WHERE role = 'assistant')"
_KIND = "CASE " + " ".join(f"WHEN key IN ({', '.join(repr(p) for p in phrases)}) THEN '{kind}'" for kind, phrases in R.SMALL_TALK.items()) + " ELSE 'question' END"
_KEY = lambda c: rf"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"

ORACLE_SQL = {
    "vector_topk": f"{_BASE} SELECT vec_id AS document_id, row_number() OVER (ORDER BY {_DISTANCE}, vec_id)::INT AS vec_rank, round({_DISTANCE}, 6) AS distance FROM embeddings ORDER BY vec_rank LIMIT 20",
    "vector_topk_batch": """WITH d AS (SELECT q.vec_id AS query_id, v.vec_id AS document_id, 1 - list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), document_id)::INT AS rank FROM d)
SELECT query_id, document_id, rank, abs(round(distance, 6)) AS distance FROM r WHERE rank <= 10""",
    "text_topk": f"{_BASE} SELECT document_id, row_number() OVER (ORDER BY {_SCORE} DESC, document_id)::INT AS text_rank, round({_SCORE}, 6) AS text_score FROM tok WHERE {_MUST} ORDER BY text_rank LIMIT 32",
    "text_phrase_topk": f"""{_BASE} SELECT document_id, row_number() OVER (ORDER BY {_tf("of")} DESC, document_id)::INT AS text_rank, round({_tf("of")}, 6) AS text_score FROM tok
WHERE (list_contains(h, 'of') OR list_contains(b, 'of')) AND NOT (list_contains(h, 'src3') OR list_contains(b, 'src3')) AND contains(' ' || array_to_string(b, ' ') || ' ', ' of the ') ORDER BY text_rank LIMIT 20""",
    "hybrid_rrf": _hybrid_sql("true", "", _COLUMNS),
    "hybrid_filtered": _hybrid_sql("workspace_id = 'en'", "label IN (1, 2, 3)", _COLUMNS),
    "text_only": _hybrid_sql("true", "", "document_id, round(score, 5) AS score, text_rank::INT AS text_rank", vector=False),
    "citations": rf"""WITH {_ANSWERS},
n AS (SELECT conv_id, turn, n_results, unnest(regexp_extract_all(answer, '\[(\d{{1,2}})\]', 1))::INT AS number, generate_subscripts(regexp_extract_all(answer, '\[(\d{{1,2}})\]', 1), 1) AS i FROM a),
f AS (SELECT conv_id, turn, number, min(i) AS i FROM n WHERE number BETWEEN 1 AND n_results GROUP BY ALL)
SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1)::INT AS rank, number FROM f""",
    "sources_list": f"""WITH {model.DOCUMENTS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY document_id DESC) AS rank FROM docs WHERE status = 'ready')
SELECT workspace_id, string_agg('[' || rank || '] ' || filename || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS sources FROM r WHERE rank <= 8 GROUP BY 1""",
    "message_kinds": f"SELECT conv_id, turn, (SELECT {_KIND} FROM (SELECT {_KEY('text')} AS key)) AS kind FROM conversations",
    "answer_states": f"WITH {_ANSWERS} SELECT conv_id, turn, n_results - 3 = 0 OR trim(answer) = '' OR contains(lower(answer), 'not in the documents') AS refused FROM a",
    "lenient_json": "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events",
}

"""Vector, text and hybrid retrieval, and what is made of the results."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.text import term_frequency, terms

# fixed values: fusion constant, pool size, weights of header and body terms, citation and refusal marks
RRF_K = 60
HEADER_WEIGHT, BODY_WEIGHT = 1.0, 0.4
CITATION = r"\[(\d{1,2})\]"
SNIPPET_CHARS = 400


def pool_size(k: int) -> int:
    return max(4 * k, 20)


def cosine_distances(vectors: DataFrame, query: Sequence[float], vector_col: str = "embedding") -> DataFrame:
    """The input with ``distance`` for its vector column, by one matrix product an Arrow batch.

    Null vectors and vectors of another width have a null distance, as have zero vectors.
    """
    q = np.asarray(query, np.float64)
    q = q / (np.linalg.norm(q) or np.nan)
    rest = [c for c in vectors.columns if c != vector_col]
    schema = ", ".join(f"`{c}` {t}" for c, t in vectors.dtypes if c != vector_col) + ", distance double"

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(vector_col)
            column = batch.column(at)
            offsets = column.offsets.to_numpy()
            usable = (np.diff(offsets) == len(q)) & ~column.is_null().to_numpy(zero_copy_only=False)
            out = np.full(len(column), np.nan)
            if usable.any():
                flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
                rows = flat[(offsets[:-1][usable, None] + np.arange(len(q))[None, :])]
                norms = np.sqrt((rows * rows).sum(axis=1))
                out[usable] = 1.0 - np.divide((rows * q).sum(axis=1), norms, out=np.full(len(rows), np.nan), where=norms > 0)
            kept = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, from_pandas=True)], names=[*rest, "distance"])

    return vectors.select(*rest, vector_col).mapInArrow(run, schema)


def vector_pool(vectors: DataFrame, query: Sequence[float], k: int, id_col: str = "document_id") -> DataFrame:
    """The k nearest with ``vec_rank``; a sort with limit keeps k rows a task. Rows of equal distance go by id."""
    near = cosine_distances(vectors.select(id_col, "embedding"), query).where("distance IS NOT NULL").orderBy("distance", id_col).limit(k)
    return near.withColumn("vec_rank", F.row_number().over(Window.orderBy("distance", id_col)))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "document_id", block: int = 1024) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest vectors of every query (query_id, embedding), exactly, equal distances by id.

    Queries go out in broadcast blocks of bounded size, each a pass over the vectors: a matrix product an Arrow batch, of which a
    task keeps its k best a query. Vectors that are null, zero or of another width take no part.
    """
    out, held = [], []

    def search(rows: list) -> DataFrame:
        ids = np.array([r[0] for r in rows], np.int64)
        q = np.array([r[1] for r in rows], np.float64)
        sent = vectors.sparkSession.sparkContext.broadcast((ids, q / np.linalg.norm(q, axis=1, keepdims=True)))

        def run(batches):
            ids, q = sent.value
            best_d, best_i = np.full((len(ids), 0), 0.0), np.full((len(ids), 0), 0, np.int64)
            for batch in batches:
                rows = [(i, v) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if i is not None and v is not None and len(v) == q.shape[1] and any(v)]
                if not rows:
                    continue
                m = np.array([v for _, v in rows], np.float64)
                d = np.hstack([best_d, 1.0 - q @ (m / np.linalg.norm(m, axis=1, keepdims=True)).T])
                i = np.hstack([best_i, np.broadcast_to(np.array([i for i, _ in rows], np.int64), (len(ids), len(rows)))])
                order = np.lexsort((i, d), axis=1)[:, :k]
                best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
            n = best_d.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(best_i.ravel()), pa.array(best_d.ravel())], names=["query_id", id_col, "distance"])

        return vectors.select(F.col(id_col).cast("long"), "embedding").mapInArrow(run, f"query_id long, {id_col} long, distance double")

    width = None
    for row in queries.where("query_id IS NOT NULL AND embedding IS NOT NULL").select("query_id", "embedding").orderBy("query_id").toLocalIterator():
        width = width or len(row.embedding)
        if len(row.embedding) == width and any(row.embedding):
            held.append(row)
        if len(held) == block:
            out.append(search(held))
            held = []
    if held:
        out.append(search(held))
    if not out:
        return vectors.select(F.lit(0).cast("long").alias("query_id"), F.col(id_col).cast("long"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).where("false")
    every = reduce(DataFrame.unionByName, out)
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", id_col))).where(F.col("rank") <= k)


def text_scores(docs: DataFrame, must: Sequence[str], must_not: Sequence[str] = (), phrases: Sequence[str] = (), header_col: str = "header", body_col: str = "content") -> DataFrame:
    """Rows that hold all terms and phrases and none of the excluded terms, with ``text_score``.

    The score is the weighted frequency of the terms: those of the header count more than the body's. A phrase counts as a
    term of the body.
    Texts without a term as a substring are dropped before any is cut into terms.
    """
    sides = [F.lower(F.coalesce(c, F.lit(""))) for c in (header_col, body_col)]
    words = [t.lower() for t in must] + [w for p in phrases for w in p.lower().split()]
    likely = reduce(lambda a, b: a & b, [F.concat_ws(" ", *sides).contains(w) for w in words], F.lit(True))
    # counted once a row; filters above read the counts and not the texts
    counts = {t: F.struct(*[term_frequency(side, t.lower()) for side in sides]) for t in (*must, *must_not)}
    found = docs.where(likely).withColumn("__n", F.array(*[F.struct(c["col1"].alias("h"), c["col2"].alias("b")) for c in counts.values()]) if counts else F.array())
    at = {t: F.col("__n")[i] for i, t in enumerate(counts)}
    total = lambda t: at[t]["h"] + at[t]["b"]
    joined = F.concat(F.lit(" "), F.array_join(terms(sides[1]), " "), F.lit(" "))
    shown = [f" {' '.join(p.lower().split())} " for p in phrases]
    stands = [joined.contains(p) for p in shown]
    rules = [total(t) > 0 for t in must] + [total(t) == 0 for t in must_not] + stands
    score = sum((at[t]["h"] * HEADER_WEIGHT + at[t]["b"] * BODY_WEIGHT for t in must), F.lit(0.0))
    if not must:
        # white space is doubled, so that a phrase which ends where the next begins counts twice
        wide = F.replace(joined, F.lit(" "), F.lit("  "))
        score = sum(((F.size(F.split(wide, re.escape(p.replace(" ", "  ")[1:-1]))) - 1) * BODY_WEIGHT for p in shown), F.lit(0.0))
    return found.where(reduce(lambda a, b: a & b, rules, F.lit(True))).withColumn("text_score", score).drop("__n")


def text_pool(docs: DataFrame, must: Sequence[str], k: int, id_col: str = "document_id", **more) -> DataFrame:
    best = text_scores(docs, must, **more).select(id_col, "text_score").orderBy(F.desc("text_score"), id_col).limit(k)
    return best.withColumn("text_rank", F.row_number().over(Window.orderBy(F.desc("text_score"), id_col)))


def fuse(vector: DataFrame | None, text: DataFrame, k: int, id_col: str = "document_id", order: Sequence[str] | None = None) -> DataFrame:
    """Reciprocal rank fusion of two ranked pools; a missing half adds nothing. Without a query vector it is the text half alone."""
    part = lambda rank: F.coalesce(F.lit(1.0) / (F.lit(RRF_K) + F.col(rank)), F.lit(0.0))
    both = text.select(id_col, "text_rank").withColumn("vec_rank", F.lit(None).cast("int")) if vector is None else vector.select(id_col, "vec_rank").join(text.select(id_col, "text_rank"), id_col, "full")
    return both.withColumn("score", part("vec_rank") + part("text_rank")).orderBy(F.desc("score"), *(order or (id_col,))).limit(k)


def hybrid_search(docs: DataFrame, vectors: DataFrame, query: Sequence[float] | None, must: Sequence[str], k: int = 8, where: Column | None = None, tags: Column | None = None) -> DataFrame:
    """The k best ready documents: (document_id, filename, header, score, vec_rank, text_rank, snippet).

    where filters documents (tenant), tags filters vectors; only ready documents take part. Both pools hold
    max(4k, 20) rows. The k winners come to the driver, so that what is shown of them is read by their ids.
    """
    ready = docs.where("status = 'ready'")
    ready = ready.where(where) if where is not None else ready
    if tags is not None:
        vectors = vectors.where(tags)
        ready = ready.join(vectors.select("document_id"), "document_id", "left_semi")
    pool = pool_size(k)
    vector = None if query is None else vector_pool(vectors.join(ready.select("document_id"), "document_id", "left_semi"), query, pool)
    best = fuse(vector, text_pool(ready, must, pool), k)
    return winners(ready, best, ("document_id",)).select("document_id", "filename", "header", F.substring("content", 1, SNIPPET_CHARS).alias("snippet"), F.round("score", 5).alias("score"), "vec_rank", "text_rank")


def winners(rows: DataFrame, best: DataFrame, key: Sequence[str]) -> DataFrame:
    """``rows`` of the k keys in ``best`` with its other columns; the first key goes to the scan as a filter. k bounds what is collected."""
    found = best.collect()
    held = rows.sparkSession.createDataFrame(found, best.schema)
    return rows.where(F.col(key[0]).isin([r[key[0]] for r in found])).join(F.broadcast(held), list(key))


def citations(answers: DataFrame, answer_col: str, count_col: str, id_cols: Sequence[str]) -> DataFrame:
    """(ids, rank, number): cited source numbers in order of first use, those out of range left out."""
    numbers = F.array_distinct(F.transform(F.regexp_extract_all(answer_col, F.lit(CITATION), F.lit(1)), lambda n: n.cast("int")))
    inside = F.filter(numbers, lambda n: (n >= 1) & (n <= F.col(count_col)))
    return answers.select(*id_cols, F.posexplode(inside).alias("rank", "number"))


def cited_sources(cited: DataFrame, results: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Citations (group, ..., rank, number) with the result rows (group, rank, ...) that they name; the first result is number 1."""
    named = results.withColumnRenamed("rank", "number")
    return cited.join(named, [*group_cols, "number"])


def answer(results: DataFrame, replies: DataFrame, group_cols: Sequence[str], refusal: str) -> DataFrame:
    """(group, text, refused) of each asked group: its reply, or the refusal where nothing was found or the reply says so.

    results: (group, rank, ...), no rows where nothing was found; replies: (group, reply), a row a group that was asked.
    """
    found = results.groupBy(*group_cols).agg(F.count("*").alias("__n"))
    rows = replies.join(found, list(group_cols), "left").withColumn("refused", answer_state(F.col("reply"), F.coalesce("__n", F.lit(0))))
    return rows.select(*group_cols, F.when(F.col("refused"), refusal).otherwise(F.trim("reply")).alias("text"), "refused")


def source_list(results: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """One numbered text of sources a group, from (rank, filename, section, content) rows of bounded groups."""
    entry = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("filename"), F.when(F.col("section") != "", F.concat(F.lit(" > "), F.col("section"))).otherwise(F.lit("")), F.lit("\n"), F.col("content"))
    gathered = results.groupBy(*group_cols).agg(F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry")))).alias("entries"))
    return gathered.select(*group_cols, F.array_join(F.col("entries.entry"), "\n\n").alias("sources"))


# fixed values: messages that are small talk when they stand alone
SMALL_TALK = {
    "greeting": ("hi", "hii", "hiii", "hey", "heya", "hello", "helo", "hiya", "howdy", "yo", "good morning", "good afternoon", "good evening", "morning", "gm", "hi there", "hello there", "hey there"),
    "thanks": ("thanks", "thank you", "thankyou", "thx", "ty", "tysm", "cheers", "ta", "thanks a lot", "thank you so much", "much appreciated", "appreciate it"),
    "ack": ("ok", "okay", "k", "kk", "cool", "nice", "great", "got it", "alright", "sure", "fine", "perfect", "awesome", "understood"),
    "farewell": ("bye", "goodbye", "good bye", "see you", "see ya", "cya", "later"),
    "meta": ("help", "what can i ask", "what can i ask you", "what should i ask", "how do i use this", "how does this work", "what is this", "what documents do you have", "which documents do you have", "what files do you have", "what do you know"),
}


def message_kind(text: Column) -> Column:
    """The kind of a message that is small talk as a whole, null for a question."""
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))
    return F.coalesce(*[F.when(key.isin(*phrases), kind) for kind, phrases in SMALL_TALK.items()])


def answer_state(answer: Column, n_results: Column, refusal_mark: str = "not in the documents") -> Column:
    """refused where nothing was found, nothing was said, or the refusal mark was."""
    return (n_results == 0) | (F.trim(F.coalesce(answer, F.lit(""))) == "") | F.lower(answer).contains(refusal_mark)


def lenient_object(raw: Column, schema: str) -> Column:
    """The JSON object in a model's reply: fenced, bare, or between the outermost braces; empty struct fields otherwise."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    loose = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.from_json(F.when(fenced != "", fenced).otherwise(loose), schema)

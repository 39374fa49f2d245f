"""Replies to small talk, upload guards, tag filters, and work that a model client does in batches."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.operators.ranges import row_numbers
from docquarry.operators.retrieval import message_kind

# fixed values: limits of requests and uploads
MAX_QUESTION, MAX_TOP_K, MIN_PASSWORD, MIN_USERNAME = 4000, 50, 8, 2
SECTION_BATCH, EMBED_BATCH = 25, 32
regex_terms = regex.compile(r"[\p{L}\p{N}]+").findall


def listing(items: Column, most: int) -> Column:
    """a, b and c; over ``most`` items: the first ones, and how many more there are."""
    n = F.size(items)
    many = F.concat(F.array_join(F.slice(items, 1, most), ", "), F.lit(", and "), (n - most).cast("string"), F.lit(" more"))
    few = F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(items, -1))
    return F.when(n > most, many).when(n > 1, few).when(n == 1, F.element_at(items, 1)).otherwise(F.lit(""))


def overview(kind: Column, names: Column, topics: Column, processing: Column) -> Column:
    """What is said of a workspace instead of an answer: what it holds, what it covers, what is still in work."""
    hello = F.when(kind == "greeting", "Hi. ").otherwise(F.lit(""))
    count = F.size(names)
    holds = F.concat(hello, F.lit("This workspace has "), count.cast("string"), F.when(count == 1, " document: ").otherwise(F.lit(" documents: ")), listing(names, 5), F.lit("."))
    covers = F.when(F.size(topics) > 0, F.concat(F.lit(" Topics: "), listing(topics, 6), F.lit(".")))
    waits = F.when(processing > 0, F.concat(F.lit(" In work: "), processing.cast("string"), F.lit(".")))
    empty = F.concat(hello, F.when(processing > 0, F.concat(processing.cast("string"), F.lit(" document(s) are in work."))).otherwise(F.lit("There are no documents yet.")))
    return F.when(kind == "thanks", "You're welcome.").when(kind == "farewell", "Bye.").when(kind == "ack", "Ask about the documents whenever you like.").when(count == 0, empty).otherwise(F.concat(holds, F.coalesce(covers, F.lit("")), F.coalesce(waits, F.lit(""))))


def reject_reason(size: Column, mime: Column, most: int) -> Column:
    """Why an upload is not taken, null if it is."""
    return F.when(size > most, "too large").when(size == 0, "empty").when(mime.isNull(), "unsupported type")


def question_ok(question: Column, top_k: Column) -> Column:
    return F.length(F.trim(question)).between(1, MAX_QUESTION) & top_k.between(1, MAX_TOP_K)


def credentials_ok(username: Column, password: Column) -> Column:
    """Whether a name, trimmed, and a password are long enough; null is not."""
    return F.coalesce((F.length(F.trim(username)) >= MIN_USERNAME) & (F.length(password) >= MIN_PASSWORD), F.lit(False))


def save_exchanges(messages: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Messages (workspace_id, user_id, turn, role, content) with both turns of every exchange (workspace_id, user_id, seq, question, answer).

    Turns count on from a user's last one in the workspace, in seq order; question and answer are one row of the input, so that
    never one stands without the other.
    """
    key = ["workspace_id", "user_id"]
    last = messages.groupBy(*key).agg(F.max("turn").alias("__last"))
    numbered = row_numbers(exchanges, key, ("seq",), "__n").join(last, key, "left")
    turn = F.coalesce(F.col("__last") + 1, F.lit(0)) + (F.col("__n") - 1) * 2
    both = F.inline(F.array(F.struct(turn.alias("turn"), F.lit("user").alias("role"), F.col("question").alias("content")), F.struct((turn + 1).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("content"))))
    return messages.select(*key, "turn", "role", "content").unionByName(numbered.select(*key, both))


def may_act(role: Column, action: Column) -> Column:
    """Administrators may do all; readers may ask and search."""
    return F.coalesce((role == "admin") | action.isin("ask", "search", "read"), F.lit(False))


def has_tags(tags: Column, wanted: dict[str, str | Sequence[str]]) -> Column:
    """Containment: a scalar must be equal, a list must be a subset of the array; keys are and-ed, an empty list always holds."""
    cond = F.lit(True)
    for key, value in wanted.items():
        have = tags[key]
        cond = cond & (have == value if isinstance(value, str) else F.size(F.array_except(F.array(*map(F.lit, value)).cast("array<string>"), have)) == 0)
    return F.coalesce(cond, F.lit(False))


def hashing_embedder(dim: int) -> Callable[[list[str]], np.ndarray]:
    """Unit vectors of hashed term counts: texts with the same words are near each other. A text without a term is a zero vector."""

    def embed(texts: list[str]) -> np.ndarray:
        rows = np.zeros((len(texts), dim))
        for row, text in zip(rows, texts, strict=True):
            for term, n in Counter(regex_terms(text.lower())).items():
                row[int(hashlib.md5(term.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % dim] += n
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)

    return embed


def embed_texts(rows: DataFrame, id_col: str, text_col: str, client: Callable[..., np.ndarray], dim: int, batch: int = EMBED_BATCH, task: str | None = None) -> DataFrame:
    """(id, embedding): the client gets ``batch`` texts at a time, in order, and must return a vector of ``dim`` for each.

    With a ``task`` ("document" or "query") the client is told it too, for models that embed the two differently.
    """
    kind = dict(rows.dtypes)[id_col]
    more = () if task is None else (task,)

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            made = [np.asarray(client(texts[i : i + batch], *more), np.float32) for i in range(0, len(texts), batch)]
            if any(m.ndim != 2 or m.shape[1] != dim for m in made) or sum(map(len, made)) != len(texts):
                raise ValueError(f"the client must return one vector of width {dim} a text")
            flat = np.concatenate(made).ravel() if made else np.zeros(0, np.float32)
            offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=[id_col, "embedding"])

    return rows.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, embedding array<float>")


def complete_texts(rows: DataFrame, id_col: str, prompt_col: str, client: Callable[[list[str]], list[str]], batch: int = SECTION_BATCH) -> DataFrame:
    """(id, reply): prompts go to the client in batches; a batch that fails has null replies and the rest goes on."""
    kind = dict(rows.dtypes)[id_col]

    def run(batches):
        for b in batches:
            prompts, out = b.column(1).to_pylist(), []
            for i in range(0, len(prompts), batch):
                part = prompts[i : i + batch]
                try:
                    out += client(part)
                except Exception:  # a client may fail in any way; its batch stays without replies
                    out += [None] * len(part)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[id_col, "reply"])

    return rows.select(id_col, prompt_col).mapInArrow(run, f"{id_col} {kind}, reply string")


def route(messages: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Messages (workspace_id, ..., text) with ``route`` and ``reply``: small talk is answered from the workspace, a question is searched for.

    workspaces: (workspace_id, names, topics, processing). A workspace that isn't there has nothing; a question's reply is null.
    """
    kind = message_kind(F.col("text"))
    none = F.array().cast("array<string>")
    joined = messages.join(workspaces, "workspace_id", "left").withColumns({"names": F.coalesce("names", none), "topics": F.coalesce("topics", none), "processing": F.coalesce("processing", F.lit(0))})
    said = F.when(kind.isNotNull(), overview(kind, F.col("names"), F.col("topics"), F.col("processing")))
    return joined.select(*messages.columns, F.coalesce(kind, F.lit("question")).alias("route"), said.alias("reply"))

"""One question from its text to the saved exchange: small talk or search, prompt, reply, citations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.operators.answers import route, save_exchanges
from docquarry.operators.questions import search_chunks
from docquarry.operators.retrieval import answer, citations, cited_sources, source_list, winners

# fixed value: what stands in for an answer that the documents don't give
REFUSAL = "That is not in the documents."
PROMPT = "Answer from the numbered sources alone and name those used as [number].\n\n{sources}\n\nQuestion: {question}"
KEY = ("document_id", "ordinal")


@dataclass
class Exchange:
    """What came of a question: the answer, what it cites (rank, number, document_id, ordinal, filename, section, score, snippet), and the messages with both turns."""

    route: str
    text: str
    refused: bool
    cited: DataFrame
    messages: DataFrame


def ask(passages: DataFrame, workspaces: DataFrame, messages: DataFrame, workspace: str, user, question: str, embed: Callable[[str], Sequence[float]], complete: Callable[[str], str], k: int = 8) -> Exchange:
    """Answers one question of a user in a workspace and adds the exchange to the messages (workspace_id, user_id, turn, role, content).

    passages: as for ``search_chunks``, with workspace_id; workspaces: as for ``route``. Small talk is answered from the
    workspace. A question is embedded, searched for among the workspace's ready passages, and the k best go to ``complete`` as
    numbered sources, whole. Where nothing is found nobody is asked, and the answer is the refusal, as it is where the reply says so
    or is empty. The sources and the reply of this one question are all that comes to the driver.
    """
    spark = passages.sparkSession
    asked = spark.createDataFrame([(workspace, question)], "workspace_id string, text string")
    kind, said = route(asked, workspaces).select("route", "reply").first()
    own = F.col("workspace_id") == workspace
    best = search_chunks(passages, question, embed(question), k, own) if kind == "question" else passages.where("false").withColumns({"score": F.lit(0.0), "snippet": F.lit("")})
    ranked = best.select(*KEY, "filename", "section", "score", "snippet").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "ordinal", "document_id")))
    held = spark.createDataFrame(ranked.collect(), ranked.schema).withColumn("ask", F.lit(1))  # k rows
    text, refused = said, False
    cited = held.where("false")
    if kind == "question":
        whole = winners(passages.where(own).select(*KEY, "content"), held.select(*KEY, "ask", "rank", "filename", "section"), KEY)
        shown = source_list(whole, ("ask",)).first()
        reply = complete(PROMPT.format(sources=shown.sources, question=question)) if shown else None
        replies = spark.createDataFrame([(1, reply, held.count())], "ask int, reply string, n_results int")
        text, refused = answer(held, replies.select("ask", "reply"), ("ask",), REFUSAL).select("text", "refused").first()
        if not refused:
            cited = cited_sources(citations(replies, "reply", "n_results", ("ask",)).withColumnRenamed("rank", "place"), held, ("ask",)).withColumnRenamed("place", "rank")
    new = spark.createDataFrame([(workspace, user, 0, question, text)], f"workspace_id string, user_id {dict(messages.dtypes)['user_id']}, seq int, question string, answer string")
    return Exchange(kind, text, refused, cited.select("rank", *(["number"] if "number" in cited.columns else [F.lit(0).alias("number")]), *KEY, "filename", "section", "score", "snippet"), save_exchanges(messages, new))

"""Headers, digests and heading trees of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.operators.answers import complete_texts
from docquarry.operators.catalog import distinct_spellings
from docquarry.operators.retrieval import lenient_object

DESCRIPTION_CHARS = 200
PROFILE = "document_type string, topics array<string>, entities array<string>"


def context_header(document: Column, path: Column, description: Column) -> Column:
    """document > path… - description; empty parts are left out."""
    parts = F.concat(F.array(document), F.coalesce(path, F.array().cast("array<string>")))
    head = F.array_join(F.filter(parts, lambda p: F.trim(p) != ""), " > ")
    told = F.trim(F.coalesce(description, F.lit("")))
    return F.when(told != "", F.concat(head, F.lit(" - "), told)).otherwise(head)


def embedding_text(header: Column, content: Column) -> Column:
    return F.when(F.coalesce(header, F.lit("")) != "", F.concat(header, F.lit("\n\n"), content)).otherwise(content)


def section_digest(rows: DataFrame, budget: int = 600, sections: int = 40) -> DataFrame:
    """(doc, section, digest, omitted): each section's text up to a budget of characters, first sections only.

    rows: (doc_id, section_no, section, block_no, text). Texts are added while those before them are
    under the budget, then the whole is cut to it; ``omitted`` counts the document's other sections.
    """
    side = Window.partitionBy("doc_id", "section_no").orderBy("block_no")
    before = F.coalesce(F.sum(F.length("text")).over(side.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = rows.withColumn("__before", before).where(F.col("__before") < budget)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"]), " ")
    one = kept.groupBy("doc_id", "section_no", "section").agg(F.substring(joined, 1, budget).alias("digest"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("section_no"))
    total = F.count("*").over(Window.partitionBy("doc_id"))
    return one.withColumns({"__n": n, "omitted": F.greatest(total - sections, F.lit(0))}).where(F.col("__n") <= sections).drop("__n")


def heading_tree(headings: DataFrame, most: int = 120) -> DataFrame:
    """(doc_id, tree): headings indented by level, the first ``most`` lines. headings: (doc_id, block_no, level, text)."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_no"))
    lines = headings.withColumn("__n", n).where(F.col("__n") <= most).withColumn("line", F.concat(F.expr("repeat('  ', level - 1)"), F.col("text")))
    gathered = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("__n", "line"))).alias("rows"))
    return gathered.select("doc_id", F.array_join(F.col("rows.line"), "\n").alias("tree"))


def section_samples(chunks: DataFrame) -> DataFrame:
    """(doc_id, section, sample): the first chunk of each section, by ordinal."""
    return chunks.groupBy("doc_id", "section").agg(F.min_by("content", "ordinal").alias("sample"))


def describe(rows: DataFrame, key: list[str], text_col: str, client: Callable[[list[str]], list[str]]) -> DataFrame:
    """(key, description): what a client says of each text, DESCRIPTION_CHARS at most; null where it fails or says nothing."""
    asked = rows.select(F.struct(*key).alias("__key"), F.col(text_col).alias("__text"))
    told = F.trim(F.substring(F.trim("reply"), 1, DESCRIPTION_CHARS))
    return complete_texts(asked, "__key", "__text", client).select("__key.*", F.when(told != "", told).alias("description"))


def contextualise(chunks: DataFrame, client: Callable[[list[str]], list[str]], per_chunk: bool = False) -> DataFrame:
    """Chunks (doc_id, ordinal, document, section, path, content) with their ``header``.

    The client describes the first chunk of every section, or with ``per_chunk`` each chunk; a chunk without a description has
    its document and path alone. Null sections are one section.
    """
    key = ["doc_id", "ordinal"] if per_chunk else ["doc_id", "section"]
    told = describe(chunks, key, "content", client) if per_chunk else describe(section_samples(chunks), key, "sample", client)
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"d.{k}")) for k in key]
    joined = chunks.alias("c").join(told.alias("d"), same, "left")
    header = context_header(F.col("c.document"), F.col("c.path"), F.col("d.description"))
    return joined.select(*[F.col(f"c.{c}") for c in chunks.columns if c != "header"], header.alias("header"))


def profile(reply: Column, most: int = 12) -> Column:
    """A document's profile from a model's reply: type and distinct trimmed values; empty where there is no object in the reply."""
    read = lenient_object(reply, PROFILE)
    values = lambda name: F.coalesce(distinct_spellings(read[name], most), F.array().cast("array<string>")).alias(name)
    return F.struct(F.coalesce(F.trim(read["document_type"]), F.lit("")).alias("document_type"), values("topics"), values("entities"))

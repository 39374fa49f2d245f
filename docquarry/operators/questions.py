"""Search from a question as it is typed: parsing, stems, stop words, and a rank by how close the words stand.

A question is alternatives of literals: words and quoted phrases, all of which must stand in a text, and those after a
minus, none of which may. ``or`` divides alternatives. Stop words ask for nothing. Matching is by stems, which are
prefixes of the words they stand for, so that a plain substring test drops most texts before any is cut into terms.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.text import terms
from docquarry.operators.retrieval import BODY_WEIGHT, HEADER_WEIGHT, SNIPPET_CHARS, fuse, pool_size, vector_pool, winners

# fixed values: English words that ask for nothing, endings that stems leave out
STOP_WORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from further "
    "had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own "
    "s same she should so some such t than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves".split()
)
STEM = r"^([a-z]{3,}?)(?:ings|ing|ied|ies|edly|ed|es|ly|s|y|e)$"


def stem(term: Column) -> Column:
    """A lower-case term without a common English ending; three letters stay."""
    return F.regexp_replace(term, STEM, "$1")


def stem_of(term: str) -> str:
    return re.sub(STEM, r"\1", term)


@dataclass
class Literals:
    """What one alternative asks for, each literal as its stems."""

    must: list[tuple[str, ...]] = field(default_factory=list)
    must_not: list[tuple[str, ...]] = field(default_factory=list)


def parse(question: str, stop_words: Sequence[str] = STOP_WORDS, stem: Callable[[str], str] = stem_of) -> list[Literals]:
    """Alternatives of a question; those that ask for no word are left out, so a question of stop words has none."""
    out = [Literals()]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', question):
        if not phrase and not minus and word.lower() == "or":
            out.append(Literals())
            continue
        bare = word[1:] if not minus and word.startswith("-") else word
        cut = [t for t in re.split(r"[\W_]+", (phrase or bare).lower()) if t]
        stems = tuple(stem(t) for t in cut if t not in stop_words)
        if stems:
            # a word with marks inside is a phrase of its parts
            (out[-1].must_not if minus or bare != word else out[-1].must).append(stems)
    return [x for x in out if x.must]


def _hits(stems: Column, literal: tuple[str, ...]) -> Column:
    """Places (from 0) at which a literal begins in an array of stems."""
    places = F.filter(F.transform(stems, lambda s, i: F.when(s == literal[0], i)), lambda i: i.isNotNull())
    return reduce(lambda at, k: F.filter(at, lambda i: F.get(stems, i + k) == literal[k]), range(1, len(literal)), places)


def _located(stems: Column, literal: tuple[str, ...], number: int, weight: float, offset: Column) -> Column:
    """Hits of a literal in one side of a chunk; the header's places are negative and the body's begin at 1, so the two never touch."""
    hit = lambda i: F.struct(F.lit(number).alias("literal"), (i + offset).alias("lo"), (i + offset + len(literal) - 1).alias("hi"), F.lit(weight).alias("weight"))
    return F.transform(_hits(stems, literal), hit)


def _covers(hits: DataFrame, wanted: int, lengths: Sequence[int], key: Sequence[str]) -> DataFrame:
    """(key, text_score) from hits (key, literal, lo, hi, weight): the sum over the least spans that hold every literal.

    A span counts the harmonic mean of its literals' weights, divided by one more than the other words in it.
    """
    side = Window.partitionBy(*key).orderBy("hi", "lo", "literal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = [F.last(F.when(F.col("literal") == k, F.struct("lo", "weight")), ignorenulls=True).over(side) for k in range(wanted)]
    spans = hits.withColumn("__last", F.array(*last)).where(~F.exists("__last", lambda x: x.isNull()))
    lo = F.array_min(F.transform("__last", lambda x: x["lo"]))
    weight = wanted / F.aggregate("__last", F.lit(0.0), lambda a, x: a + 1.0 / x["weight"])
    least = spans.select(*key, lo.alias("lo"), F.struct("hi", weight.alias("w")).alias("end")).groupBy(*key, "lo").agg(F.min("end").alias("end"))
    noise = F.greatest(F.lit(0), F.col("end.hi") - F.col("lo") + 1 - sum(lengths))
    return least.groupBy(*key).agg(F.sum(F.col("end.w") / (1 + noise)).alias("text_score"))


def question_scores(chunks: DataFrame, question: str, key: Sequence[str], header_col: str = "header", body_col: str = "content") -> DataFrame:
    """(key, text_score) of the chunks that answer at least one alternative; scores of alternatives add up.

    Words of the header come before the body's and weigh more; no literal spans both. Only chunks that pass the substring
    test are cut into terms, and only the places of the question's words go on from there.
    """
    sides = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in (header_col, body_col)]
    both = F.concat_ws(" ", *sides)
    found = []
    for a, want in enumerate(parse(question)):
        likely = reduce(lambda x, y: x & y, [both.contains(s) for literal in want.must for s in literal])
        cut = chunks.where(likely).select(*key, *[F.transform(terms(side), stem).alias(f"__{k}") for k, side in enumerate(sides)])
        literals = [*enumerate(want.must), *((-1, x) for x in want.must_not)]
        hits = [_located(F.col(f"__{k}"), x, n, (HEADER_WEIGHT, BODY_WEIGHT)[k], F.lit(1) if k else -F.size("__0")) for n, x in literals for k in (0, 1)]
        rows = cut.select(*key, F.flatten(F.array(*hits)).alias("hits"))
        kept = rows.where(~F.exists("hits", lambda h: h["literal"] == -1)).select(*key, F.explode("hits").alias("h")).select(*key, "h.*")
        found.append(_covers(kept, len(want.must), [len(x) for x in want.must], key).withColumn("alternative", F.lit(a)))
    if not found:
        return chunks.select(*key, F.lit(0.0).alias("text_score")).where("false")
    return reduce(DataFrame.unionByName, found).groupBy(*key).agg(F.sum("text_score").alias("text_score"))


def question_pool(chunks: DataFrame, question: str, k: int, key: Sequence[str] = ("document_id", "ordinal")) -> DataFrame:
    """The k best (key, text_score, text_rank); equal scores go by key."""
    best = question_scores(chunks, question, key).withColumn("text_score", F.round("text_score", 9)).orderBy(F.desc("text_score"), *key).limit(k)
    return best.withColumn("text_rank", F.row_number().over(Window.orderBy(F.desc("text_score"), *key)))


def search_chunks(chunks: DataFrame, question: str, query: Sequence[float] | None, k: int = 8, where: Column | None = None, text: DataFrame | None = None) -> DataFrame:
    """The k best chunks of ready documents, as passages with all that an answer shows of them.

    chunks: (document_id, ordinal, filename, status, header, section, content, tags, embedding), tenant columns for ``where``.
    Both pools hold max(4k, 20) chunks, fused by reciprocal ranks; equal scores go by ordinal, then document.
    (document_id, ordinal, filename, header, section, tags, snippet, score, vec_rank, text_rank); chunks without a vector take part by their text alone. ``text`` is the text's pool (document_id, ordinal, text_score,
    text_rank), where an index has found it.
    """
    ready = chunks.where("status = 'ready'")
    ready = ready.where(where) if where is not None else ready
    key = F.struct("document_id", "ordinal").alias("chunk")
    vector = None if query is None else vector_pool(ready.where(F.col("embedding").isNotNull()).select(key, "embedding"), query, pool_size(k), "chunk")
    text = (question_pool(ready, question, pool_size(k)) if text is None else text).select(key, "text_score", "text_rank")
    best = fuse(vector, text, k, "chunk", order=("chunk.ordinal", "chunk.document_id")).select("chunk.document_id", "chunk.ordinal", "score", "vec_rank", "text_rank")
    shown = ready.select("document_id", "ordinal", "filename", "header", "section", "tags", F.substring("content", 1, SNIPPET_CHARS).alias("snippet"))
    return winners(shown, best, ("document_id", "ordinal"))

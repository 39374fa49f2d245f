"""Benchmark decontamination: BM25 with block-max WAND, every passage a query.

Test items are the indexed documents. A term's impact on an item is its BM25
weight divided by the item's own full score, so one threshold fits all items:
a passage's score for an item is the share of the item it covers. Items are classed by
length, and training texts are cut for each class into passages of twice the longest item, one at each half of that length, so that
wherever an item's window of one and a half lengths stands, a passage holds it whole.
For a passage, the sums of the terms' largest impacts, then of their largest
impacts in each block of items, are upper bounds; blocks that can't reach the
threshold are skipped. In the blocks left, cursors over the postings advance
by WAND pivots and items are scored. All items at or above the threshold are
then verified: enough of the question's words and of the answer's words must
stand together in a window of one and a half times the item's own length.

The index is built by Spark, in shards of bounded size, a task a shard. Shards of INDEX_BYTES together are
broadcast at once and run in one pass over the texts; a larger benchmark costs more passes, not a larger broadcast.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import map_rows
from docquarry.session import cut_lineage

K1, B = 1.2, 0.75
BLOCK_ITEMS = 4
THRESHOLD = 0.7  # share of an item's own score
OVERLAP = 0.8  # of the question's words, and of the answer's
#: Words of the items of the first class of lengths; each class holds items up to twice as long as the one before.
LEAST_STRIDE = 64
#: About as many items and characters of items make one index shard.
SHARD_ITEMS, SHARD_CHARS = 4_000, 8 << 20
#: Bytes of pickled shards that are broadcast at once.
INDEX_BYTES = 64 << 20
#: Half strides of a passage.
SEGMENTS = 4
#: Sums of (segment, block) are kept in an array up to this many cells, sorted beyond, with the same result.
DENSE_CELLS = 4_000_000
_words = regex.compile(r"[\p{L}\p{N}]+").findall


def words_of(text: str | None) -> list[str]:
    return _words((text or "").lower())


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item that has one text: its last sentence, or last third of words, is the answer."""
    sentences = [s for s in regex.split(r"(?<=[.!?])\s+", text.strip()) if words_of(s)]
    if len(sentences) > 1:
        return " ".join(sentences[:-1]), sentences[-1]
    words = words_of(text)
    cut = len(words) - len(words) // 3
    return " ".join(words[:cut]), " ".join(words[cut:])


@dataclass
class Index:
    """Inverted index of one shard of items, postings in blocks of BLOCK_ITEMS items."""

    ids: list[int]
    sides: list[tuple[Counter, Counter]]  # words of question and answer
    terms: dict[str, int]
    upper: np.ndarray  # term: largest impact
    post_at: np.ndarray  # term: where its postings begin
    post_item: np.ndarray
    post_impact: np.ndarray
    block_at: np.ndarray  # term: where its blocks begin
    block_no: np.ndarray
    block_max: np.ndarray
    n_blocks: int
    stride: int  # words; a passage is two strides long and begins at each half of one


def stride_of(n_words: int) -> int:
    """Longest item of the class that an item of so many words is in."""
    return max(LEAST_STRIDE, 1 << max(0, n_words - 1).bit_length())


def build_index(items: list[tuple[int, str, str]], df: dict[str, int], n_items: int, mean_len: float, stride: int) -> Index:
    """items: (id, question, answer) of one class; df, n_items and mean_len are of the whole benchmark."""
    bags = [Counter(words_of(q)) + Counter(words_of(a)) for _, q, a in items]
    idf = {t: math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) for t in set().union(*bags)}
    postings: dict[str, list[tuple[int, float]]] = {}
    for i, bag in enumerate(bags):
        size = sum(bag.values())
        impact = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean_len)) for t, f in bag.items()}
        whole = sum(impact.values()) or 1.0
        for t, x in impact.items():
            postings.setdefault(t, []).append((i, x / whole))
    terms = {t: k for k, t in enumerate(postings)}
    lists = list(postings.values())
    post_at = np.cumsum([0, *map(len, lists)])
    post_item = np.array([i for x in lists for i, _ in x], np.int64)
    post_impact = np.array([w for x in lists for _, w in x], np.float64)
    term_of = np.repeat(np.arange(len(lists)), np.diff(post_at))
    key = term_of * (len(items) // BLOCK_ITEMS + 1) + post_item // BLOCK_ITEMS
    first = np.nonzero(np.diff(key, prepend=-1))[0]
    return Index(
        ids=[i for i, _, _ in items],
        sides=[(Counter(words_of(q)), Counter(words_of(a))) for _, q, a in items],
        terms=terms,
        upper=np.maximum.reduceat(post_impact, post_at[:-1]) if len(lists) else np.zeros(0),
        post_at=post_at,
        post_item=post_item,
        post_impact=post_impact,
        block_at=np.searchsorted(first, post_at),
        block_no=post_item[first] // BLOCK_ITEMS,
        block_max=np.maximum.reduceat(post_impact, first) if len(first) else np.zeros(0),
        n_blocks=len(items) // BLOCK_ITEMS + 1,
        stride=stride,
    )


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + counts[i] - 1 of all i, joined."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def wand(index: Index, terms: np.ndarray, blocks: set[int], threshold: float) -> list[tuple[int, float]]:
    """All (item, score) at or above the threshold among the blocks, by pivots over the postings of distinct terms."""
    at, item, impact = index.post_at, index.post_item, index.post_impact
    cursors = [[int(at[t]), int(at[t + 1]), float(index.upper[t])] for t in terms]
    found = []
    eps = threshold - 1e-9
    while cursors:
        cursors.sort(key=lambda c: item[c[0]])
        bound, pivot = 0.0, None
        for c in cursors:
            bound += c[2]
            if bound >= eps:
                pivot = int(item[c[0]])
                break
        if pivot is None:
            break
        if pivot // BLOCK_ITEMS not in blocks:
            # the whole block is out by its maxima: go on at the next block
            goal = (pivot // BLOCK_ITEMS + 1) * BLOCK_ITEMS
        elif item[cursors[0][0]] == pivot:
            score = 0.0
            for c in cursors:
                if item[c[0]] != pivot:
                    break
                score += float(impact[c[0]])
            if score >= eps:
                found.append((pivot, score))
            goal = pivot + 1
        else:
            goal = pivot
        for c in cursors:
            if item[c[0]] < goal:
                c[0] += int(np.searchsorted(item[c[0] : c[1]], goal))
        cursors = [c for c in cursors if c[0] < c[1]]
    return found


def passages_of(index: Index, words: list[str], threshold: float) -> list[tuple[int, float, int]]:
    """(item, score, first word of the passage) for all passages of a text."""
    if not words:
        return []
    get, half = index.terms.get, index.stride // 2
    numbers = np.array([get(w, -1) for w in words], np.int64)
    place = np.nonzero(numbers >= 0)[0]
    if not len(place):
        return []
    term, seg = numbers[place], place // half
    n_seg = len(words) // half + 1
    # distinct terms of each segment; SEGMENTS of them make a passage
    pair = np.unique(seg * len(index.upper) + term)
    seg, term = pair // len(index.upper), pair % len(index.upper)
    bound = np.bincount(seg, weights=index.upper[term], minlength=n_seg + SEGMENTS - 1)
    could = sum(bound[k : k + n_seg] for k in range(SEGMENTS)) >= threshold - 1e-9
    if not could.any():
        return []
    # bounds by block of items, for the segments of passages still in
    used = np.zeros(n_seg + SEGMENTS - 1, bool)
    for k in range(SEGMENTS):
        used[k : k + n_seg] |= could
    keep = used[seg]
    seg, term = seg[keep], term[keep]
    counts = index.block_at[term + 1] - index.block_at[term]
    flat = _ragged(index.block_at[term], counts)
    cell = np.repeat(seg, counts) * index.n_blocks + index.block_no[flat]
    n_cells = (n_seg + SEGMENTS - 1) * index.n_blocks
    if n_cells <= DENSE_CELLS:
        sums = np.bincount(cell, weights=index.block_max[flat], minlength=n_cells).reshape(-1, index.n_blocks)
        start = np.nonzero(sum(sums[k : k + n_seg] for k in range(SEGMENTS)).ravel() >= threshold - 1e-9)[0].tolist()
    else:
        cells, where = np.unique(cell, return_inverse=True)
        sums = np.bincount(where, weights=index.block_max[flat])
        # a passage's bound is the sum of its segments' bounds
        shifts = [k * index.n_blocks for k in range(SEGMENTS)]
        firsts = np.unique(np.concatenate([cells[cells >= shift] - shift for shift in shifts]))
        total = np.zeros(len(firsts))
        for shift in shifts:
            at = np.minimum(np.searchsorted(cells, firsts + shift), len(cells) - 1)
            total += np.where(cells[at] == firsts + shift, sums[at], 0.0)
        start = firsts[total >= threshold - 1e-9].tolist()
    by_passage: dict[int, set[int]] = {}
    for c in start:
        by_passage.setdefault(c // index.n_blocks, set()).add(c % index.n_blocks)
    out = []
    for p, blocks in sorted(by_passage.items()):
        own = np.unique(term[np.searchsorted(seg, p) : np.searchsorted(seg, p + SEGMENTS)])
        # the same bounds with each term of the passage once, whatever number of segments has it
        if index.upper[own].sum() < threshold - 1e-9:
            continue
        counts = index.block_at[own + 1] - index.block_at[own]
        flat = _ragged(index.block_at[own], counts)
        sums = np.bincount(index.block_no[flat], weights=index.block_max[flat], minlength=index.n_blocks)
        if left := {b for b in blocks if sums[b] >= threshold - 1e-9}:
            out += [(i, score, p * half) for i, score in wand(index, own, left, threshold)]
    return out


def best_window(words: list[str], question: Counter, answer: Counter, overlap: float) -> tuple[int, int, float, float] | None:
    """(words found, start, share of the question, share of the answer) of the best window with enough of both.

    A window is one and a half times as long as the item and begins at a word of it; of equal ones the first counts.
    """
    n_question, n_answer = question.total(), answer.total()
    span = (3 * (n_question + n_answer) + 1) // 2
    places = [i for i, w in enumerate(words) if w in question or w in answer]
    held: Counter = Counter()
    in_question = in_answer = end = 0
    best = None
    for at in places:
        while end < len(places) and places[end] < at + span:
            w = words[places[end]]
            in_question += held[w] < question[w]
            in_answer += held[w] < answer[w]
            held[w] += 1
            end += 1
        q, a = in_question / n_question if n_question else 1.0, in_answer / n_answer if n_answer else 1.0
        if q >= overlap and a >= overlap and (best is None or in_question + in_answer > best[0]):
            best = in_question + in_answer, at, q, a
        w = words[at]
        held[w] -= 1
        in_question -= held[w] < question[w]
        in_answer -= held[w] < answer[w]
    return best


def matches(index: Index, words: list[str], threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple[int, float, float, float, int]]:
    """(item id, score, question overlap, answer overlap, first word): the best verified window of each item."""
    best: dict[int, tuple[int, int, float, float, float]] = {}
    for i, score, at in passages_of(index, words, threshold):
        found = best_window(words[at : at + 2 * index.stride], *index.sides[i], overlap)
        if found:
            n, start, question, answer = found
            rank = (n, -(at + start), round(score, 6), question, answer)
            best[i] = max(best.get(i, rank), rank)
    return [(index.ids[i], score, question, answer, -start) for i, (_, start, score, question, answer) in sorted(best.items())]


def index_shards(items: DataFrame) -> DataFrame:
    """(shard, bytes, index): pickled indexes over (item_id, question, answer), each built in a task of its own.

    Items with null ids or without a word are left out; rows equal in all three columns are one item; rows that repeat an id
    otherwise are items of their own.
    """
    rows = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer")).distinct()

    def cut(cols: dict[str, list]) -> dict[str, list]:
        bags = [Counter(words_of(q)) + Counter(words_of(a)) for q, a in zip(cols["question"], cols["answer"], strict=True)]
        return cols | {"terms": [list(b) for b in bags], "n_words": [b.total() for b in bags], "stride": [stride_of(b.total()) for b in bags]}

    sized = map_rows(rows, "item_id long, question string, answer string, terms array<string>, n_words long, stride long", cut).where("n_words > 0")
    sized = cut_lineage(sized)
    chars = F.length("question") + F.length("answer")
    classes = sized.groupBy("stride").agg(F.count("*").alias("n"), F.sum(chars).alias("chars"), F.sum("n_words").alias("words")).collect()  # one row a class of lengths
    n_items, n_words = sum(r.n for r in classes), sum(r.words for r in classes)
    if not n_items:
        return items.sparkSession.createDataFrame([], "shard string, bytes long, index binary")
    shards = F.create_map(*[F.lit(x) for r in classes for x in (r.stride, max(1, -(-r.n // SHARD_ITEMS), -(-r.chars // SHARD_CHARS)))])
    named = sized.withColumn("shard", F.concat_ws("/", "stride", F.pmod(F.xxhash64("item_id", "question", "answer"), F.element_at(shards, F.col("stride")))))
    df = named.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    needed = named.select("shard", F.explode("terms").alias("term")).distinct().join(df, "term")
    both = named.select("shard", "item_id", "question", "answer", "stride", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("df"))
    both = both.unionByName(needed.select("shard", F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("string").alias("question"), F.lit(None).cast("string").alias("answer"), F.lit(None).cast("long").alias("stride"), "term", "df"))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["term"].isna()].sort_values(["item_id", "question", "answer"])
        known = rows[rows["term"].notna()]
        index = build_index([(int(i), q, a) for i, q, a in zip(own["item_id"], own["question"], own["answer"], strict=True)], dict(zip(known["term"], known["df"], strict=True)), n_items, n_words / n_items, int(own["stride"].iloc[0]))
        data = pickle.dumps(index)
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "bytes": [len(data)], "index": [data]})

    return cut_lineage(both.groupBy("shard").applyInPandas(build, "shard string, bytes long, index binary"))


def index_groups(items: DataFrame) -> Iterator[list[Index]]:
    """Indexes in groups that fit into one broadcast; the driver holds a group at a time."""
    held, size = [], 0
    for row in index_shards(items).orderBy("shard").toLocalIterator():
        if held and size + row.bytes > INDEX_BYTES:
            yield held
            held, size = [], 0
        held.append(pickle.loads(bytes(row["index"])))
        size += row.bytes
    if held:
        yield held


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, question, answer) of a benchmark with one text an item."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        parts = [split_item(t or "") for t in cols["text"]]
        return {"item_id": cols["item_id"], "question": [q for q, _ in parts], "answer": [a for _, a in parts]}

    return map_rows(benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text")), "item_id long, question string, answer string", run)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word), one row a match of input row and item.

    Null, empty and word-free texts match nothing, nor does an empty benchmark; texts are searched whole; rows
    that repeat an id give rows each; other columns are ignored. Nothing is shuffled.
    """
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for group in index_groups(items):
        sent = docs.sparkSession.sparkContext.broadcast(group)

        def run(cols: dict[str, list], sent=sent) -> dict[str, list]:
            cut = [(doc, words_of(text)) for doc, text in zip(cols["doc_id"], cols["text"], strict=True)]
            found = [(doc, *m) for doc, words in cut for index in sent.value for m in matches(index, words, threshold, overlap)]
            return dict(zip(("doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"), zip(*found, strict=True) if found else [()] * 6, strict=True))

        out = out.unionByName(map_rows(rows, schema, run))
    return out


def keep_uncontaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The documents that match no item, with all their columns; nothing is shuffled."""
    import pyarrow as pa

    at = docs.columns.index("text")
    for group in index_groups(items):
        sent = docs.sparkSession.sparkContext.broadcast(group)

        def run(batches, sent=sent):
            for batch in batches:
                texts = map(words_of, batch.column(at).to_pylist())
                yield batch.filter(pa.array([not any(matches(index, words, threshold, overlap) for index in sent.value) for words in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

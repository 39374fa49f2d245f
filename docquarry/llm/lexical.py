"""Ranked lexical search: the best documents of every item, by a dual-tree search.

A document's vector holds a saturated frequency of each of the items' terms, an item's vector its terms' weights;
a score is their inner product, in integers throughout. Items form a tree, and so do the documents of each batch that a
task reads: documents that score alike for groups of items share a leaf. A node holds the maxima of each coordinate
below it, so the product of two nodes bounds every score between them. A pair of nodes whose bound is under the
weakest k-th score of its items is dropped with all documents and items below it. What is left at the leaves is scored; nothing
that could stand among the k best is ever dropped, so the result is exact.

Texts are cut into terms once; what later passes read are vectors over the items' terms, written to the shared
folder. Shares of the documents, a small one and then a larger, are searched first, only for the k-th scores that they have: lower
bounds that all tasks begin with when all documents are searched. A task sends on k documents an item at most.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import Batches
from docquarry.session import cut_lineage

TOP = 50
LEAF_DOCS, LEAF_ITEMS, FAN = 4, 4, 4
#: Documents of a batch at most; numbers that a batch, and that the items of one block, may hold.
BATCH, BATCH_CELLS, CELLS = 4_096, 8_000_000, 4_000_000
#: Bytes of items' terms that are sent out at once; a larger set of items costs more passes, not a larger broadcast.
GROUP_BYTES = 16 << 20
SEED_SHARES = (64, 8)
DIRECTIONS = 6
NO_ID = np.iinfo(np.int64).max
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case; UTF-8 in and out."""
    return (text or b"").translate(_FOLD).split()


def weight_of(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def hierarchy(rows: np.ndarray, leaf: int) -> list[np.ndarray]:
    """The rows, the maxima of each run of ``leaf`` rows, then of each FAN nodes, up to one node."""
    out, width = [rows], leaf
    while len(out) == 1 or len(out[-1]) > 1:
        out.append(np.maximum.reduceat(out[-1], np.arange(0, len(out[-1]), width)))
        width = FAN
    return out


def neighbours(points: np.ndarray, leaf: int) -> np.ndarray:
    """An order of the points in which runs of ``leaf`` are near each other: halves by the widest coordinate, again and again."""
    done, open_ = [], [np.arange(len(points))]
    while open_:
        at = open_.pop()
        if len(at) <= leaf:
            done.append(at)
            continue
        own = points[at]
        at = at[np.argsort(own[:, np.argmax(np.ptp(own, axis=0))], kind="stable")]
        cut = max(1, len(at) // 2 // leaf) * leaf
        open_ += [at[cut:], at[:cut]]
    return np.concatenate(done)


@dataclass
class Block:
    """Tree over some items: a level is a list of nodes (columns, values), level 0 the items themselves."""

    items: np.ndarray  # numbers of the items, in the tree's order
    columns: np.ndarray  # numbers of the terms, ascending
    dtype: type
    levels: list[list[tuple[np.ndarray, np.ndarray]]] = field(default_factory=list)

    def affinities(self, docs: np.ndarray) -> np.ndarray:
        """What documents score for each least group of items."""
        out = np.empty((len(docs), len(self.levels[1])))
        for k, (columns, values) in enumerate(self.levels[1]):
            out[:, k] = docs[:, columns] @ values
        return out

    def weakest(self, least: np.ndarray) -> list[np.ndarray]:
        """The least k-th score below each node, level by level."""
        out, width = [least[self.items]], LEAF_ITEMS
        while len(out) < len(self.levels):
            out.append(np.minimum.reduceat(out[-1], np.arange(0, len(out[-1]), width)))
            width = FAN
        return out


def _directions(n: int) -> np.ndarray:
    return np.random.default_rng(n).standard_normal((n, DIRECTIONS))


def blocks_of(items: list[np.ndarray], weights: np.ndarray) -> list[Block]:
    """Trees over the items (arrays of term numbers), each of CELLS numbers at most or of one item."""
    cuts, held, terms = [], [], set()
    for k, own in enumerate(items):
        grown = terms.union(own.tolist())
        if held and (len(held) + 1) * len(grown) > CELLS:
            cuts.append((held, terms))
            held, grown = [], set(own.tolist())
        held, terms = [*held, k], grown
    cuts.append((held, terms))
    out = []
    for held, terms in cuts:
        columns = np.array(sorted(terms), np.int64)
        # below 2**53 sums of whole numbers are exact in doubles
        exact = max(float(weights[items[k]].sum()) for k in held) * 1e6 < 2**53
        dense = np.zeros((len(held), len(columns)), np.float64 if exact else np.int64)
        for r, k in enumerate(held):
            dense[r, np.searchsorted(columns, items[k])] = weights[items[k]]
        order = neighbours(dense @ _directions(len(columns)), LEAF_ITEMS)
        block = Block(np.array(held)[order], columns, dense.dtype.type)
        for level in hierarchy(dense[order], LEAF_ITEMS):
            block.levels.append([(at := np.nonzero(row)[0], row[at]) for row in level])
        out.append(block)
    return out


def dual_search(block: Block, docs: np.ndarray, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(item number, rows of docs, scores) of all scores above 0 that reach the item's entry in ``least``.

    docs: one row a document over the block's columns, in the order of its tree.
    """
    tree, weakest = hierarchy(docs, LEAF_DOCS), block.weakest(least)
    at_doc, at_item = len(tree) - 1, len(block.levels) - 1
    live = {0: np.zeros(1, np.int64)}  # node of items: nodes of documents
    while True:
        kept = {}
        for node, nodes in live.items():
            columns, values = block.levels[at_item][node]
            bounds = tree[at_doc][np.ix_(nodes, columns)] @ values
            inside = (bounds >= weakest[at_item][node]) & (bounds > 0)
            if inside.any():
                kept[node] = nodes[inside], bounds[inside]
        if at_doc == at_item == 0:
            yield from ((int(block.items[node]), *found) for node, found in kept.items())
            return
        live = {}
        if at_doc:
            width = LEAF_DOCS if at_doc == 1 else FAN
            for node, (nodes, _) in kept.items():
                below = (nodes[:, None] * width + np.arange(width)).ravel()
                live[node] = below[below < len(tree[at_doc - 1])]
        else:
            live = {node: nodes for node, (nodes, _) in kept.items()}
        if at_item:
            width, n = (LEAF_ITEMS if at_item == 1 else FAN), len(block.levels[at_item - 1])
            live = {child: nodes for node, nodes in live.items() for child in range(node * width, min(n, (node + 1) * width))}
        at_doc, at_item = max(0, at_doc - 1), max(0, at_item - 1)


class Best:
    """The k best (score, id) of each item so far, equal scores by id, and the score that one more must reach."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k = least.copy(), k
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if item in self.held:
            scores, ids = np.concatenate([self.held[item][0], scores]), np.concatenate([self.held[item][1], ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.held[item] = scores[order], ids[order]
        if len(order) == self.k:
            self.least[item] = max(self.least[item], scores[order[-1]])


def items_in_groups(items: DataFrame, group_bytes: int = GROUP_BYTES) -> Iterator[tuple[list, dict[bytes, int], list[np.ndarray]]]:
    """(ids, terms, term numbers of each item) of groups of items; the driver holds one group at a time."""
    ids, terms, rows, size = [], {}, [], 0
    distinct = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).where("item_id IS NOT NULL").distinct()
    for row in distinct.orderBy("item_id", "text").toLocalIterator():
        own = sorted(set(terms_of(row.text)))
        if not own:
            continue
        add = sum(map(len, own)) + 16 * len(own)
        if ids and size + add > group_bytes:
            yield ids, terms, rows
            ids, terms, rows, size = [], {}, [], 0
        ids.append(row.item_id)
        rows.append(np.array([terms.setdefault(t, len(terms)) for t in own], np.int64))
        size += add
    if ids:
        yield ids, terms, rows


def vectors(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents with a term: all its terms counted, and how often it has those asked for."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)
    kinds = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    def run(batches: Batches) -> Batches:
        get = sent.value.get
        for batch in batches:
            ids, ns, numbers, counts = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cut = terms_of(text)
                if cut:
                    found = [(number, tf) for t, tf in Counter(cut).items() if (number := get(t)) is not None]
                    ids.append(doc)
                    ns.append(len(cut))
                    numbers.append([x for x, _ in found])
                    counts.append([x for _, x in found])
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, ns, numbers, counts), kinds, strict=True)], schema=kinds)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def _best_of(found: DataFrame, blocks: list[Block], least: np.ndarray, n_docs: int, n_terms: int, n_columns: int, k: int) -> DataFrame:
    """(item, doc_id, score): each task's k best of every item that reach ``least``, then the k best of all."""
    sent = found.sparkSession.sparkContext.broadcast((blocks, least))
    kinds = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64()), ("part", pa.int32())])

    def search(rows: list[tuple], blocks: list[Block], places: list[np.ndarray], best: Best) -> None:
        ids = np.array([NO_ID if r[0] is None else r[0] for r in rows], np.int64)
        sizes = np.array([50 + 50 * r[1] * n_docs // n_terms for r in rows], np.int64)
        doc = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
        term = np.array([t for r in rows for t in r[2]], np.int64)
        tf = np.array([x for r in rows for x in r[3]], np.int64)
        value = 1_000_000_000 * tf // (1000 * tf + 20 * sizes[doc])
        for block, place in zip(blocks, places, strict=True):
            step = max(LEAF_DOCS, BATCH_CELLS // max(1, len(block.columns)))
            column = place[term]
            for lo in range(0, len(rows), step):
                n = min(step, len(rows) - lo)
                own = (column >= 0) & (doc >= lo) & (doc < lo + n)
                dense = np.zeros((n, len(block.columns)), block.dtype)
                dense[doc[own] - lo, column[own]] = value[own]
                order = neighbours(block.affinities(dense), LEAF_DOCS)
                for item, at, scores in dual_search(block, dense[order], best.least):
                    best.add(item, scores.astype(np.int64), ids[lo + order[at]])

    def run(batches: Batches) -> Batches:
        from pyspark import TaskContext

        blocks, least = sent.value
        places = []
        for block in blocks:
            place = np.full(n_columns, -1, np.int64)
            place[block.columns] = np.arange(len(block.columns))
            places.append(place)
        best, held = Best(least, k), []
        for batch in batches:
            held += zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            while len(held) >= BATCH:
                search(held[:BATCH], blocks, places, best)
                held = held[BATCH:]
        if held:
            search(held, blocks, places, best)
        part = TaskContext.get().partitionId()
        for item, (scores, ids) in best.held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item, np.int32)), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(scores), pa.array(np.full(len(ids), part, np.int32))], schema=kinds)

    rows = found.mapInArrow(run, "item int, doc_id long, score long, part int")
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    # the k best of some parts, then of all, so that no task ranks k rows of every task
    some = rows.withColumn("part", F.pmod("part", F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    return some.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, seed_shares: Sequence[int] = SEED_SHARES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of each item with the highest scores above 0.

    docs: (doc_id, text), items: (item_id, text); other columns are ignored. Equal scores go by ascending id, null ids last;
    rows that repeat an id are documents of their own. Texts that are null or have no term are no documents; items with a
    null id are left out, rows equal in id and text are one item, another text under the same id is an item of its own.
    No documents or no items with a term give an empty result. Items are searched in groups of bounded size, each a pass over the texts.
    """
    spark = docs.sparkSession
    out = None
    for ids, terms, rows in items_in_groups(items, group_bytes):
        found = cut_lineage(vectors(docs, terms))
        n_docs, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break
        df = np.zeros(len(terms), np.int64)
        for term, n in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect():  # a row a term of the group
            df[term] = n
        blocks = blocks_of(rows, np.array([weight_of(n_docs, x) for x in df.tolist()], np.int64))
        search = lambda part, least: _best_of(part, blocks, least, n_docs, n_terms, len(terms), k)  # noqa: E731, B023
        least = np.zeros(len(ids), np.int64)
        for share in seed_shares:
            for row in search(found.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(share)) == 0), least).where(F.col("rank") == k).collect():  # a row an item
                least[row.item] = row.score
        named = spark.createDataFrame(list(enumerate(ids)), "item int, item_id long")
        best = search(found, least).join(F.broadcast(named), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out

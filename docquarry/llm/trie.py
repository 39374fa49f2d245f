"""Prefix trie of conversations, in balanced parentheses.

Conversations that begin alike share a path. Runs of nodes with the same members are one segment, so the trie has at most two
segments a conversation; a conversation that shares its path with others k times has k others at least, the i-th of i turns or more,
so a path has at most about the square root of twice the turns in segments, however long the conversation is.

Paths are put in order and cut into shards, ranges of conversations of any number. Each shard writes its part of the trie as
parentheses, one pair a segment, with a tree of the least excess of blocks over them: the close of a pair is the first place
with less excess, a subtree is what lies between, the pairs "()" in it are its leaves, and its savings are a difference of cumulative
sums. What a shard shares with a neighbour is the path between them, its spine: the shard that comes first counts a shared
segment itself, each counts what is below in its own range, and the sums over shards merge the spines.

Turn prefixes are hashed by 128 bits of exclusive-ors of a hash of place and turn, scanned over spread conversations. All work
before and after the shards is on narrow rows; texts don't leave the tasks that read them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import Batches
from docquarry.operators.ranges import row_numbers, scan, spread_join
from docquarry.session import cut_lineage

BLOCK = 64
FAMILY = 100  # conversations of one shared opening
MOST_SHARED = 6  # an opening has fewer turns
IDS_PER_CHUNK = 65_536
NODE = ("x1", "x2")


class Parentheses:
    """A balanced sequence with the least excess of each block, pair of blocks, pair of pairs and so on."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens
        self.excess = np.cumsum(np.where(opens, 1, -1))
        self.rank = np.concatenate([[0], np.cumsum(opens)])  # pairs opened before a place
        leaf = opens[:-1] & ~opens[1:] if len(opens) else np.zeros(0, bool)
        self.leaf_rank = np.concatenate([[0], np.cumsum(leaf), [int(leaf.sum())]]) if len(opens) else np.zeros(1, np.int64)
        n_blocks = -(-len(opens) // BLOCK)
        padded = np.full((n_blocks, BLOCK), len(opens) + 1)
        padded.ravel()[: len(opens)] = self.excess
        self.blocks = padded
        self.mins = [padded.min(axis=1) if n_blocks else np.zeros(0, np.int64)]
        while len(self.mins[-1]) > 1:
            at = self.mins[-1]
            at = np.append(at, len(opens) + 1) if len(at) % 2 else at
            self.mins.append(at.reshape(-1, 2).min(axis=1))

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The place of the close of each open at ``at``: the first one after it with an excess below its own."""
        goal = self.excess[at] - 1
        out = np.full(len(at), -1)
        block = at // BLOCK
        # in the open's own block, as many queries at once as fit
        for lo in range(0, len(at), 65_536):
            part = slice(lo, lo + 65_536)
            hit = (self.blocks[block[part]] <= goal[part, None]) & (np.arange(BLOCK)[None, :] > (at[part] % BLOCK)[:, None])
            found = hit.any(axis=1)
            out[part] = np.where(found, block[part] * BLOCK + hit.argmax(axis=1), -1)
        far = np.nonzero(out < 0)[0]
        # up from the next block to a node with less excess, then down to its first block of that kind
        level, node, goal = np.zeros(len(far), np.int64), block[far] + 1, goal[far]
        down = np.zeros(len(far), bool)
        value = np.zeros(len(far), np.int64)
        active = np.ones(len(far), bool)
        while active.any():
            for k, mins in enumerate(self.mins):
                here = active & (level == k)
                value[here] = mins[node[here]]
            less = value <= goal
            done = active & less & (level == 0)
            active &= ~done
            enter = active & less  # the first half, the second if that has none
            down |= enter
            level[enter] -= 1
            node[enter] *= 2
            go_on = active & ~less
            node[go_on] += 1
            rise = go_on & ~down & (node % 2 == 0)
            level[rise] += 1
            node[rise] //= 2
        for lo in range(0, len(far), 65_536):
            part = slice(lo, lo + 65_536)
            out[far[part]] = node[part] * BLOCK + (self.blocks[node[part]] <= goal[part, None]).argmax(axis=1)
        return out


def _plain(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, mark, points): a null role or text is empty; mark stands for both."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    mark = F.sha2(F.concat(F.sha2(role, 256), F.sha2(text, 256)), 256)
    return turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), mark.alias("mark"), F.length(text).cast("long").alias("points"))


def plain_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, part, n, mark, points) of conversations as they are; part 0, number 0 is the root."""
    own = row_numbers(_plain(turns), ("conv_id",), ("turn", "role", "mark")).select("conv_id", F.lit(1).alias("part"), "n", "mark", "points")
    return own.unionByName(_roots(own.select("conv_id").distinct()))


def _roots(ids: DataFrame) -> DataFrame:
    return ids.select("conv_id", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("n"), F.lit("").alias("mark"), F.lit(0).cast("long").alias("points"))


def rebuilt_paths(turns: DataFrame) -> DataFrame:
    """The same of conversations with a shared opening: conversation c takes the first h turns of c - c % 100 in place of its own.

    h is the crc32 of c in decimal, modulo 6. Where the other one has fewer turns all are taken, none where it is absent.
    """
    own = cut_lineage(row_numbers(_plain(turns), ("conv_id",), ("turn", "role", "mark")))
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST_SHARED))
    ids = own.select("conv_id").distinct()
    # an id has at most FAMILY others that open with it, with fewer than MOST_SHARED turns each
    openings = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("n") < MOST_SHARED)).select(F.col("conv_id").alias("family"), "n", "mark", "points")
    heads = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"), shared.alias("h")).join(openings, "family").where("n <= h")
    tails = own.where(F.col("n") > shared)
    cut = lambda df, part: df.select("conv_id", F.lit(part).alias("part"), "n", "mark", "points")
    return cut(heads, 0).unionByName(cut(tails, 1)).unionByName(_roots(ids))


def prefixes(paths: DataFrame) -> DataFrame:
    """(conv_id, pos, x1, x2, p1, p2, points, cum, last): each turn with the hashes of the turns up to it and up to the one before it."""
    order = ("part", "n")
    placed = scan(paths, ("conv_id",), order, sums={"count": F.lit(1), "cum": F.col("points")}, leads={"more": F.lit(1)})
    own = placed.withColumns({f"h{k}": F.xxhash64(F.lit(k), "count", "mark") for k in (1, 2)})
    hashed = scan(own, ("conv_id",), order, xors={"x1": F.col("h1"), "x2": F.col("h2")})
    before = [F.col(f"x{k}").bitwiseXOR(F.col(f"h{k}")).alias(f"p{k}") for k in (1, 2)]
    return cut_lineage(hashed.select("conv_id", (F.col("count") - 1).alias("pos"), *NODE, *before, "points", "cum", F.col("more").isNull().alias("last")))


def nodes_of(rows: DataFrame) -> DataFrame:
    """(pos, x1, x2, points, cum, n, conv_id, parent_n, parent_conv_id, head), one row a node; a head begins a segment."""
    nodes = cut_lineage(rows.groupBy("pos", *NODE).agg(F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("points").alias("points"), F.first("cum").alias("cum"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id")))
    below = nodes.where("pos > 0")
    fan = below.groupBy("p1", "p2").agg(F.count("*").alias("size"))
    parents = nodes.select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("n").alias("parent_n"), F.col("conv_id").alias("parent_conv_id")).join(fan, ["p1", "p2"])
    found = spread_join(below, parents, ("p1", "p2"), "size")
    root = nodes.where("pos = 0").withColumns({"parent_n": F.lit(None).cast("long"), "parent_conv_id": F.lit(None).cast("long")})
    both = found.select(root.columns).unionByName(root)
    return cut_lineage(both.withColumn("head", F.col("parent_n").isNull() | (F.col("n") < F.col("parent_n"))))


def sharded_segments(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(x1, x2, tail_pos, tail_cum, n_children, n_leaves, below), one row a segment, by parentheses in shards of the ordered paths.

    The tail is a segment's last node; n_children are the tail's, below is saved by the segments under it.
    """
    heads = nodes.where("head").select("x1", "x2", "n", F.col("n").alias("size"))
    on_path = spread_join(rows.select("conv_id", "pos", "x1", "x2", "points", "cum"), heads, NODE, "size")
    ends = rows.where("last").select("conv_id", F.col("pos").alias("end_pos"), F.col("cum").alias("end_cum"))
    step = F.struct("pos", (F.col("cum") - F.col("points")).alias("before"), *NODE, "n")
    # as many steps as the path has segments
    paths = on_path.groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("steps")).join(ends, "conv_id")
    key = F.flatten(F.transform("steps", lambda s: F.array(s["x1"], s["x2"]))).alias("key")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = paths.select("conv_id", "end_pos", "end_cum", "steps", key).repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    placed = cut_lineage(placed.select("end_pos", "end_cum", "steps", "key", F.spark_partition_id().alias("part")))
    borders = placed.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last")).orderBy("part").collect()  # a row a shard
    around = {}
    for i, row in enumerate(borders):
        around[row.part] = (borders[i - 1]["last"] if i else [], borders[i + 1]["first"] if i + 1 < len(borders) else [])
    sent = rows.sparkSession.sparkContext.broadcast(around)
    kinds = pa.schema([*((c, pa.int64()) for c in ("x1", "x2", "tail_pos", "tail_cum", "n_children", "n_leaves", "below")), ("shared", pa.bool_())])

    def run(batches: Batches) -> Batches:
        shard = Shard()
        for batch in batches:
            for end_pos, end_cum, steps, part in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if shard.before is None:
                    shard.before, shard.after = sent.value[part]
                shard.add(steps, end_pos, end_cum)
        if shard.before is not None:
            for lo in range(0, len(shard.heads), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + (1 << 16)], f.type) for c, f in zip(shard.columns(), kinds, strict=True)], schema=kinds)

    found = cut_lineage(placed.mapInArrow(run, "x1 long, x2 long, tail_pos long, tail_cum long, n_children long, n_leaves long, below long, shared boolean"))
    spines = found.where("shared").groupBy(*NODE).agg(F.first("tail_pos").alias("tail_pos"), F.first("tail_cum").alias("tail_cum"), *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "below")])
    return found.where("NOT shared").drop("shared").unionByName(spines)


def _common(a: list, b: list) -> int:
    """How many segments two keys share from the root on; a segment is two numbers."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n) // 2


class Shard:
    """One shard's part of the trie, written as its paths come in order; what its neighbours' nearest paths are tells the spines."""

    def __init__(self):
        self.before: list | None = None
        self.after: list = []
        self.heads: list[tuple[int, int]] = []
        self.tails: list[tuple[int, int]] = []
        self.parents: list[int] = []
        self.own: list[int] = []  # saved in the segment itself
        self.parens: list[bool] = []
        self.path: list[int] = []  # open segments
        self.made: list | None = None

    def add(self, steps: list[dict], end_pos: int, end_cum: int) -> None:
        path, heads = self.path, self.heads
        same, most = 0, min(len(path), len(steps))
        while same < most and heads[path[same]] == (steps[same]["x1"], steps[same]["x2"]):
            same += 1
        self.parens += [False] * (len(path) - same)
        del path[same:]
        for i in range(same, len(steps)):
            step, more = steps[i], steps[i + 1] if i + 1 < len(steps) else None
            tail = (more["pos"] - 1, more["before"]) if more else (end_pos, end_cum)
            self.parents.append(path[-1] if path else -1)
            path.append(len(heads))
            heads.append((step["x1"], step["x2"]))
            self.tails.append(tail)
            self.own.append((step["n"] - 1) * (tail[1] - step["before"]))
            self.parens.append(True)

    def columns(self) -> list[np.ndarray]:
        if self.made is None:
            n = len(self.heads)
            opens = np.array(self.parens + [False] * len(self.path), bool)
            trie = Parentheses(opens)
            at = np.nonzero(opens)[0]
            close = trie.findclose(at)
            first, end = trie.rank[at], trie.rank[close]  # a subtree's numbers
            key = [x for k in self.path for x in self.heads[k]]
            # the first path is made of the first segments, the last one is what is still open
            inherited = np.zeros(n, bool)
            n_lead = next((k for k in range(n) if self.parents[k] != k - 1), n)
            inherited[: _common([x for head in self.heads[:n_lead] for x in head], self.before)] = True
            shared = inherited.copy()
            shared[self.path[: _common(key, self.after)]] = True
            saved = np.concatenate([[0], np.cumsum(np.where(inherited, 0, np.array(self.own, np.int64)))])
            parents = np.array(self.parents, np.int64)
            children = np.bincount(parents[(parents >= 0) & ~inherited], minlength=n)
            leaves = trie.leaf_rank[close] - trie.leaf_rank[at]
            if self.path and len(self.after) >= len(key) and self.after[: len(key)] == key:
                leaves[self.path] -= 1  # the last path's end goes on in the next shard, or ends there too
            below = saved[end] - saved[first + 1]
            tails = np.array(self.tails, np.int64).reshape(n, 2)
            heads = np.array(self.heads, np.int64).reshape(n, 2)
            self.made = [heads[:, 0], heads[:, 1], tails[:, 0], tails[:, 1], children, leaves, below, shared]
        return self.made


def end_digests(rows: DataFrame) -> DataFrame:
    """(x1, x2, ends_sha256) of the nodes at which conversations end: SHA-256 of their ids, ascending, with commas between.

    Ids are put in order over spread ranges and joined to chunks there; a node's chunks are then hashed one after another as they
    stream by, so a task holds one chunk, whatever the node.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = (*NODE, "conv_id")
    placed = rows.where("last").select(*keys).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    chunk = pa.schema([("x1", pa.int64()), ("x2", pa.int64()), ("least", pa.int64()), ("ids", pa.string())])

    def join(batches: Batches) -> Batches:
        node, held = None, []
        for batch in batches:
            out = []
            for x1, x2, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held and (node != (x1, x2) or len(held) == IDS_PER_CHUNK):
                    out.append((*node, held[0], ",".join(map(str, held))))
                    held = []
                node = (x1, x2)
                held.append(c)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), chunk, strict=True)], schema=chunk)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*node, held[0], ",".join(map(str, held))), chunk, strict=True)], schema=chunk)

    kinds = pa.schema([("x1", pa.int64()), ("x2", pa.int64()), ("ends_sha256", pa.string())])

    def digest(batches: Batches) -> Batches:
        node, state = None, None
        for batch in batches:
            out = []
            for x1, x2, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if node != (x1, x2):
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = (x1, x2), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*node, state.hexdigest()), kinds, strict=True)], schema=kinds)

    chunks = placed.mapInArrow(join, "x1 long, x2 long, least long, ids string").repartition(parts, *NODE).sortWithinPartitions(*NODE, "least")
    return chunks.mapInArrow(digest, "x1 long, x2 long, ends_sha256 string")


def prefix_trie(paths: DataFrame) -> DataFrame:
    """One row a node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    paths: (conv_id, part, n, mark, points), of ``plain_paths`` or ``rebuilt_paths``: turns in the order of part and n, each with
    a digest of role and text and the length of its text; rows of a conversation without turns hold its root alone. A node is named by its
    smallest member and its depth. ``saved_tokens`` sums, over a node's subtree, what its members but one repeat: its own last text. A node where no
    conversation ends has the digest of nothing. Rows without a conversation id are left out; equal turn numbers go by role, then
    by digest; rows that are equal are turns of their own; other columns are ignored; an empty table has no nodes, not even a root.
    """
    rows = prefixes(paths)
    nodes = nodes_of(rows)
    segments = sharded_segments(rows, nodes)
    named = nodes.join(segments.select(*NODE, F.struct("tail_pos", "tail_cum", "n_children", "n_leaves", "below").alias("own")), list(NODE), "left").join(end_digests(rows), list(NODE), "left")
    # a node and its segment have the same members, so the same smallest one, along whose path segments are handed down
    whole = scan(named, ("conv_id",), ("pos",), lasts={"s": F.col("own")})
    tail = F.col("pos") == F.col("s.tail_pos")
    saved: Column = F.col("s.below") + (F.col("n") - 1) * (F.col("s.tail_cum") - F.col("cum") + F.col("points"))
    nothing = hashlib.sha256(b"").hexdigest()
    return whole.select(
        "conv_id",
        F.col("pos").alias("depth"),
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        F.when(tail, F.col("s.n_children")).otherwise(F.lit(1).cast("long")).alias("n_children"),
        F.col("s.n_leaves").alias("n_leaves"),
        saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )

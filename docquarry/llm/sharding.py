"""Sharding by histogram sort: probe for splitters, then exchange once.

Rows are ordered by (hash of the text, id, row number), so equal texts lie side by side.
Candidate boundaries are probed in rounds: each round counts, across all
partitions, the exact bytes and rows below every candidate, and the bracket
of each splitter that is not settled is probed more finely in the next one.
A shard boundary that misses its share by little enough between two texts is
taken there, which leaves equal texts together; only a group of copies too
large for that is cut, between two ids, and rows with equal texts and ids only if they are too
large in turn. Shards are cut into parts by the same splitters. As the exact row counts below
each splitter are known then, every row's slot is known from its place in its part, and whole
rows are exchanged once.

Row numbers are 0 unless a group of equal texts and ids has to be cut. Then the rows are
numbered and written to the shared folder first, so that the numbers hold when they are read again.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import Batches
from docquarry.session import cut_lineage

WORDS = 3  # 64-bit words of a key: hash, id, row number
TOP = 1 << (64 * WORDS)
LOW = -(1 << 63)
PROBES = 128  # candidates for each open splitter and round
MAX_PARTS = 65_536
MAX_CANDIDATES = 1 << 18  # of one round; splitters that find no room wait for a later one


@dataclass
class Splitter:
    """Where a part begins: all rows whose key is at or above ``key``."""

    goal: float  # bytes that should lie below
    slack: float
    lo: int = 0  # rows between lo and hi, both included, are still in question
    hi: int = TOP - 1
    key: int = 0
    rows: int = 0  # below the key
    miss: float = float("inf")
    done: bool = False
    met: bool = field(default=True)  # False where rows with one key are in the way

    def offer(self, key: int, below: int, rows: int) -> None:
        if abs(below - self.goal) < self.miss:
            self.key, self.rows, self.miss = key, rows, abs(below - self.goal)


def _candidates(s: Splitter, n: int) -> list[int]:
    """About n boundaries that cut the bracket: between hashes if it has more than one, else between ids, else between rows.

    Its own ends are boundaries too, known ones, so that the gap which holds the goal lies inside it.
    """
    ends = [s.lo, *([s.hi + 1] if s.hi + 1 < TOP else [])]
    for unit in (1 << 128, 1 << 64, 1):
        first, last = s.lo // unit + 1, s.hi // unit
        if first <= last:
            step = max(1, (last - first + 1) // n)
            return [k * unit for k in range(first, last, step)] + [last * unit, *ends]
    return ends


def _packed(*columns: np.ndarray) -> np.ndarray:
    """Signed 64-bit columns as byte strings in key order."""
    flat = np.stack([c.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63) for c in columns], axis=1)
    return flat.astype(">u8").view(f"S{8 * WORDS}").ravel()


def _bytes_of(keys: list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(k.to_bytes(8 * WORDS, "big") for k in keys), f"S{8 * WORDS}")


def _key_of(data: bytes) -> int:
    return int.from_bytes(data.ljust(8 * WORDS, b"\0"), "big")


def _counts(slim: DataFrame, keys: list[int]) -> list[tuple[int, int, int, int]]:
    """For each gap between sorted candidates: bytes, rows, smallest and largest key in it."""
    sent = slim.sparkSession.sparkContext.broadcast(_bytes_of(keys))

    def count(batches: Batches) -> Batches:
        marks = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            *key, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(WORDS + 1))
            key = _packed(*key)
            order = np.argsort(key, kind="stable")
            key, size = key[order], size[order]
            at = np.searchsorted(marks, key, side="right")
            first = np.nonzero(np.diff(at, prepend=-1))[0]
            last = np.append(first[1:], len(at)) - 1
            wide = lambda x: pa.array([v.ljust(8 * WORDS, b"\0") for v in x.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(at[first]), pa.array(np.add.reduceat(size, first)), pa.array(last - first + 1), wide(key[first]), wide(key[last])], names=["g", "b", "r", "lo", "hi"])

    told = slim.select("h", "d", "t", "size").mapInArrow(count, "g long, b long, r long, lo binary, hi binary")
    out = [(0, 0, TOP, -1)] * (len(keys) + 1)
    for row in told.groupBy("g").agg(F.sum("b").alias("b"), F.sum("r").alias("r"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
        out[row.g] = (row.b, row.r, _key_of(bytes(row.lo)), _key_of(bytes(row.hi)))
    return out


def find_splitters(slim: DataFrame, goals: list[tuple[float, float]]) -> list[Splitter]:
    """Splitters for (bytes below, slack) goals, ascending by key.

    slim: (h, d, t, size). What a round brings to the driver has MAX_CANDIDATES
    rows at most. Rounds go on until no splitter is open: each leaves a splitter a small part of the keys it had. Those with the most
    slack, which bound shards, come first. A splitter that no key can settle, as rows with equal keys can't be cut, takes the nearest boundary
    there is and isn't ``met`` if these are more than one row.
    """
    splitters = [Splitter(goal, slack) for goal, slack in goals]
    total, n_rows = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    for s in splitters:
        s.offer(0, 0, 0)
        s.offer(TOP - 1, total, n_rows)
    open_ = sorted((s for s in splitters if s.miss > s.slack), key=lambda s: -s.slack)
    while open_:
        wave = open_[: max(1, MAX_CANDIDATES // PROBES)]
        keys = sorted({k for s in wave for k in _candidates(s, PROBES)})
        gaps = _counts(slim, keys)
        marks, below, rows = [], 0, 0
        for b, r, _, _ in gaps[:-1]:
            below, rows = below + b, rows + r
            marks.append((below, rows))
        for s in wave:
            i = bisect_right(marks, (s.goal, float("inf")))  # keys[i] is the first candidate with more than the goal below
            for k in (i - 1, i):
                if 0 <= k < len(keys):
                    s.offer(keys[k], *marks[k])
            _, held, s.lo, s.hi = gaps[i]
            one = held == 0 or s.lo == s.hi
            s.done = one or s.miss <= s.slack
            s.met = s.miss <= s.slack or held <= 1
        open_ = [s for s in open_ if not s.done]
    return sorted(splitters, key=lambda s: s.key)


def _part(splitters: list[Splitter], offsets: list[int], spark) -> Column:
    """(part, start) of (h, d, t): the number of splitters at or below the key, found in broadcast arrays, and the part's first slot."""
    sent = spark.sparkContext.broadcast((_bytes_of([s.key for s in splitters]), np.array(offsets, np.int64)))

    def find(h: pd.Series, d: pd.Series, t: pd.Series) -> pd.DataFrame:
        marks, starts = sent.value
        at = np.searchsorted(marks, _packed(h.to_numpy(), d.to_numpy(), t.to_numpy()), side="right")
        return pd.DataFrame({"part": at.astype(np.int32), "start": starts[at]})

    return F.pandas_udf(find, "part int, start long")


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in (c.lower() for c in taken):
        name += "_"
    return name


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 32 << 20, slack: float = 0.005) -> DataFrame:
    """The input with ``size``, ``shard`` and ``slot``, exchanged to parts of one shard each.

    size: UTF-8 bytes of the text (null: none) plus 1. Shards differ from an
    equal share of the bytes by ``slack`` of it at most at either end, unless a single row is
    larger. slot numbers a shard's rows from 0 without gaps, in key order. Null ids come first among
    equal texts. An empty table gives an empty result; input columns named size, shard or slot are replaced, all others kept.

    There are as many parts as ``part_bytes`` asks for, each a partition of the result and an entry of the
    broadcast table. Parts grow beyond that where there would be more than MAX_PARTS: to 1.6 GB at 100 TB.
    """
    spark = docs.sparkSession
    docs = docs.drop("size", "shard", "slot")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    h, d, t, where = (_free(f"__{x}", docs.columns) for x in ("hash", "id", "row", "part"))
    keyed = docs.withColumns({h: F.xxhash64(text), d: F.coalesce(F.col(id_col).cast("long"), F.lit(LOW)), "size": F.octet_length(text).cast("long") + 1})
    slim = cut_lineage(keyed.select(F.col(h).alias("h"), F.col(d).alias("d"), F.lit(0).cast("long").alias("t"), "size"))
    total = slim.agg(F.sum("size")).first()[0] or 0
    part_bytes = max(part_bytes, -(-total // MAX_PARTS))
    per = max(1, -(-total // (shards * part_bytes)))
    share = total / shards
    goals = [(total * i / (shards * per), share * slack if i % per == 0 else share / per * 0.1) for i in range(1, shards * per)]
    splitters = find_splitters(slim, goals)
    keyed = keyed.withColumn(t, F.lit(0).cast("long"))
    if not all(s.met for s in splitters):
        keyed = cut_lineage(keyed.withColumn(t, F.monotonically_increasing_id()))
        splitters = find_splitters(keyed.select(F.col(h).alias("h"), F.col(d).alias("d"), F.col(t).alias("t"), "size"), goals)
    starts = [0, *(s.rows for s in splitters)]
    offsets = [starts[p] - starts[p - p % per] for p in range(shards * per)]
    part = F.col(f"{where}.part")
    dealt = keyed.withColumn(where, _part(splitters, offsets, spark)(h, d, t)).repartitionById(shards * per, part)
    in_part = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = dealt.sortWithinPartitions(h, d, t).withColumn("slot", in_part + F.col(f"{where}.start"))
    return placed.withColumn("shard", (part / per).cast("int")).drop(h, d, t, where)


def sharded_digest(docs: DataFrame, shards: int = 8, part_bytes: int = 32 << 20) -> DataFrame:
    """The contract's columns of sharded documents."""
    out = shard_by_bytes(docs.select("doc_id", "text"), shards, part_bytes=part_bytes)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return out.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Chat formatting after a collapse of cumulative snapshots.

Logs often hold a conversation again and again as it grows. Turn-prefix
hashes are rolled over each conversation; one whose last hash is also a
prefix hash of a longer one is a snapshot of it, and an anti-join drops it. Of
equal conversations the smallest id stays. The others are rendered.

All of that works on narrow rows: a turn is its conversation, number, role and
a digest. Prefix hashes are polynomial, so they come from a scan over range-partitioned
turns: each partition rolls its own turns, the partitions' totals for the
conversation that crosses their border (one row each) are combined, and rows
are corrected by what came before. A conversation of any length is spread over as
many tasks as it needs.

Texts are exchanged once, to be rendered: by conversation where one has at most
LONG_ROWS rows; longer ones turn by turn, then in parts of TURNS_PER_PART turns.
The ids of the longer ones are broadcast if they are at most MAX_LONG_IDS; else all
conversations are rendered as the longer ones are, with the same result.
"""

from __future__ import annotations

import hashlib
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import Batches
from docquarry.session import cut_lineage

MOD = (1 << 127) - 1
POINT = int.from_bytes(hashlib.sha256(b"turn prefix").digest()[:15], "big")
TURNS_PER_PART = 256
LONG_ROWS = 1_024
TURNS_PER_BLOCK = 65_536
MAX_LONG_IDS = 1_000_000
Turn = tuple[int, int, int]


def _join(before: Turn, after: Turn) -> Turn:
    """(turns, rows, hash) of one run of turns after another."""
    return before[0] + after[0], before[1] + after[1], (before[2] * pow(POINT, after[0], MOD) + after[2]) % MOD


def _mark() -> Column:
    """16 bytes that stand for role and text."""
    side = lambda c: F.coalesce(F.sha2(c, 256), F.lit("-"))
    return F.unhex(F.substring(F.sha2(F.concat(side("role"), side("text")), 256), 1, 32))


def _plain(turns: DataFrame) -> DataFrame:
    rows = turns.where(F.col("conv_id").isNotNull())
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, mark, pos, rows, prefix, last): turns in order with the hash of all turns up to theirs.

    Turns are ordered by number, role and mark (a digest of role and text), nulls first; rows equal in all four columns
    count once, ``rows`` being how many there are up to a turn; rows without a conversation id are left out. ``last``
    tells a conversation's last turn. Texts don't leave the tasks that read them.
    """
    spark = turns.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _plain(turns).groupBy("conv_id", "turn", "role", _mark().alias("mark")).agg(F.count("*").alias("n"))
    keys = ("conv_id", "turn", "role", "mark")
    placed = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("conv_id", "turn", "mark", "n", F.spark_partition_id().alias("part"))
    kinds = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("mark", pa.binary()), ("pos", pa.int64()), ("rows", pa.int64()), ("prefix", pa.binary()), ("part", pa.int32())])

    def roll(batches: Batches) -> Batches:
        conv, state = None, (0, 0, 0)
        for batch in batches:
            ids, marks, counts = (batch.column(i).to_pylist() for i in (0, 2, 3))
            states = []
            for c, mark, n in zip(ids, marks, counts, strict=True):
                state = _join(state if c == conv else (0, 0, 0), (1, n, int.from_bytes(mark, "big") % MOD))
                conv = c
                states.append(state)
            pos, rows, hashes = [s[0] for s in states], [s[1] for s in states], [s[2].to_bytes(16, "big") for s in states]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(pos, pa.int64()), pa.array(rows, pa.int64()), pa.array(hashes, pa.binary()), batch.column(4)], schema=kinds)

    rolled = cut_lineage(placed.mapInArrow(roll, "conv_id long, turn long, mark binary, pos long, rows long, prefix binary, part int"))
    # one row for each partition: its first conversation and the state of its last one
    ends = rolled.groupBy("part").agg(F.max(F.struct("conv_id", "pos", "rows", "prefix")).alias("end"), F.min("conv_id").alias("first")).orderBy("part").collect()
    carry: dict[int, tuple[int, Turn]] = {}
    follows: dict[int, int] = {}
    conv, state = None, (0, 0, 0)
    for row, after in zip_longest(ends, ends[1:]):
        if row.first == conv:
            carry[row.part] = (conv, state)
        if after is not None:
            follows[row.part] = after.first
        state = _join(state if row.end.conv_id == conv else (0, 0, 0), (row.end.pos, row.end.rows, int.from_bytes(row.end.prefix, "big")))
        conv = row.end.conv_id
    sent = spark.sparkContext.broadcast((carry, follows))  # an entry a partition
    fixed = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("mark", pa.binary()), ("pos", pa.int64()), ("rows", pa.int64()), ("prefix", pa.binary()), ("last", pa.bool_())])

    def correct(batches: Batches) -> Batches:
        carry, follows = sent.value
        held: list[tuple] = []

        def out(rows: list[tuple], next_id: int | None) -> pa.RecordBatch:
            last = [a[0] != b for a, b in zip(rows, [*(r[0] for r in rows[1:]), next_id], strict=True)]
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*cols, last], fixed, strict=True)], schema=fixed)

        part = None
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True))
            if not rows:
                continue
            part = batch.column(6)[0].as_py()
            if before := carry.get(part):
                for i, (c, turn, mark, pos, n, h) in enumerate(rows):
                    if c != before[0]:
                        break
                    state = _join(before[1], (pos, n, int.from_bytes(h, "big")))
                    rows[i] = (c, turn, mark, state[0], state[1], state[2].to_bytes(16, "big"))
            if held:
                yield out(held, rows[0][0])
            held = rows
        if held:
            yield out(held, follows.get(part))

    return rolled.mapInArrow(correct, "conv_id long, turn long, mark binary, pos long, rows long, prefix binary, last boolean")


def maximal(prefixed: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that no longer one begins with, one of equal ones."""
    whole = prefixed.where("last").groupBy("prefix", "pos").agg(F.min("conv_id").alias("conv_id"))
    inner = prefixed.where("NOT last").select("prefix", "pos").distinct()
    return whole.join(inner, ["prefix", "pos"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"))


def _shown(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("user")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def format_chats(turns: DataFrame, turns_per_part: int = TURNS_PER_PART, long_rows: int = LONG_ROWS, max_long_ids: int = MAX_LONG_IDS) -> DataFrame:
    """(conv_id, n_turns, part, text) of the maximal conversations, rendered in parts of bounded turns.

    A turn is rendered as <|im_start|>role, a line end, the text, <|im_end|> and a line end; a null role is "user",
    a null text is empty. Most conversations have one part, part 0. Other columns are
    ignored; an empty table gives an empty result.
    """
    prefixed = prefixes(turns)
    kept = cut_lineage(maximal(prefixed))
    wide = (F.col("rows") > long_rows) | (F.col("pos") > turns_per_part)
    long_ids = cut_lineage(prefixed.where("last").where(wide).select("conv_id"))
    plain, short, rest, places = _plain(turns), None, _plain(turns), prefixed
    if long_ids.count() <= max_long_ids:
        ids = F.broadcast(long_ids)  # at most max_long_ids
        one = plain.join(ids, "conv_id", "left_anti").join(kept, "conv_id")
        whole = one.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.collect_set(F.struct("turn", "role", _mark().alias("mark"), "text")).alias("rows"))
        short = whole.select("conv_id", "n_turns", F.lit(0).cast("long").alias("part"), F.array_join(F.transform(F.array_sort("rows"), lambda r: _shown(r["role"], r["text"])), "").alias("text"))
        rest, places = plain.join(ids, "conv_id", "left_semi"), prefixed.join(ids, "conv_id", "left_semi")
    # a kept conversation gives one row for each block of its turns, so that no join key has more rows than a block
    block = lambda pos: F.floor((pos - 1) / TURNS_PER_BLOCK)
    blocks = kept.select("conv_id", "n_turns", F.explode(F.sequence(F.lit(0).cast("long"), block(F.col("n_turns")))).alias("__block"))
    places = places.withColumn("__block", block(F.col("pos"))).join(blocks, ["conv_id", "__block"])
    # turn by turn: each distinct turn is a key of its own, whatever conversation it is of
    keys = ("conv_id", "__turn", "__null", "mark")
    keyed = lambda df: df.withColumns({"__turn": F.coalesce("turn", F.lit(0)), "__null": F.col("turn").isNull()})
    texts = keyed(rest.withColumn("mark", _mark())).groupBy(*keys).agg(F.max(_shown(F.col("role"), F.col("text"))).alias("shown"))
    places = keyed(places).select(*keys, "pos", "n_turns")
    part = F.floor((F.col("pos") - 1) / turns_per_part).cast("long").alias("part")
    gathered = texts.join(places, list(keys)).groupBy("conv_id", part).agg(F.max("n_turns").alias("n_turns"), F.array_sort(F.collect_list(F.struct("pos", "shown"))).alias("turns"))
    long = gathered.select("conv_id", "n_turns", "part", F.array_join(F.col("turns.shown"), "").alias("text"))
    return long if short is None else short.unionByName(long)

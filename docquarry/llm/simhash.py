"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are grouped to distinct values first, so exact copies cost one
value. A tile holds the values whose four 16-bit lanes have the same
population counts. Each differing bit moves one lane's count by one, so two
values within the radius lie in tiles whose count vectors are at most the
radius apart; all other tile pairs are skipped unseen (a refinement of the
total population count, which such pairs exceed or not alike). The tiles left
are compared whole with numpy exclusive-or and bit counts. Of the links found
in one group only a spanning forest is written, so groups of thousands of
near copies never become all their pairs.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import Batches, lower_ascii, map_rows
from docquarry.operators.components import connected_components
from docquarry.session import cut_lineage

LANES = (0, 16, 32, 48)
BASE = 17  # counts of a 16-bit lane are 0..16, so there are at most 17**4 tiles


def fingerprint_text(text: str | None) -> int:
    """64-bit SimHash of the 3-word shingles, repeats included; 0 where there is no word."""
    words = lower_ascii(text or "")
    words = [w for w in words.translate(_SPACES).split(" ") if w]
    if not words:
        return 0
    grams = words if len(words) < 3 else None
    grams = [" ".join(words)] if grams else [f"{a} {b} {c}" for a, b, c in zip(words, words[1:], words[2:], strict=False)]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(grams), 65_536):
        part = np.array([digest(g, 42) for g in grams[at : at + 65_536]], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.nonzero(counts * 2 > len(grams))[0].astype(np.uint64)).sum(dtype=np.uint64))


_SPACES = {c: " " for c in range(0x09, 0x0E)}


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, fp): one row per input row; h is a hash of the text, fp the signed view of the fingerprint."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        fps = np.array([fingerprint_text(t) for t in cols["text"]], dtype=np.uint64)
        return {"doc_id": cols["doc_id"], "h": cols["h"], "fp": fps.view(np.int64)}

    text = F.col(text_col).cast("string")
    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text")), "doc_id long, h long, fp long", run)


def _tile_key(fps: np.ndarray) -> np.ndarray:
    key = np.zeros(len(fps), np.int64)
    for shift in LANES:
        key = key * BASE + np.bitwise_count((fps >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64)
    return key


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Count vectors at most ``radius`` away, one of each +- pair, without the zero vector."""
    span = range(-radius, radius + 1)
    return [v for v in product(span, repeat=len(LANES)) if 0 < sum(map(abs, v)) <= radius and next(x for x in v if x) > 0]


def _chunk(fps: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        spread = (fps * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return (spread % n.astype(np.uint64)).astype(np.int64)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes under links a-b."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        new = label.copy()
        np.minimum.at(new, la, low)
        np.minimum.at(new, lb, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def _links_of(members: np.ndarray, others: np.ndarray, own: bool, radius: int, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars over members (and visitors) of one group, as (value, root value)."""
    values = np.concatenate([members, others])
    label = np.arange(len(values))
    for i in range(0, len(members), block):
        left = members[i : i + block, None]
        for j in range(i if own else len(members), len(values), block):
            right = values[j : j + block] if own or j >= len(members) else others[:0]
            near = np.bitwise_count(left ^ right[None, :]) <= radius
            x, y = np.nonzero(near)
            x, y = x + i, y + j
            keep = x != y
            if keep.any():
                a, b = label[x[keep]], label[y[keep]]
                label = forest(len(values), a, b)[label]
    child = np.nonzero(label != np.arange(len(values)))[0]
    return values[child], values[label[child]]


def near_links(distinct: DataFrame, radius: int = 2, tile_rows: int = 32_768) -> DataFrame:
    """Distinct fingerprints (fp) to links (u, v) with the same components as all pairs within the radius.

    The histogram of tiles that goes to the driver has at most 17**4 rows.
    Tiles above ``tile_rows`` values are dealt into chunks and compared chunk
    by chunk, so that no group outgrows a task.
    """
    spark = distinct.sparkSession

    def keys(batches: Batches) -> Batches:
        total = np.zeros(BASE ** len(LANES), np.int64)
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            np.add.at(total, _tile_key(fps), 1)
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["k", "n"])

    sizes = distinct.select("fp").mapInArrow(keys, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    chunks = np.zeros(BASE ** len(LANES), np.int32)
    # a chunk's number has 16 bits; in tiles of over 2**31 values chunks grow instead
    tile_rows = max([tile_rows, *(-(-row.n // ((1 << 16) - 1)) for row in sizes)])
    for row in sizes:
        chunks[row.k] = -(-row.n // tile_rows)
    sent, near = spark.sparkContext.broadcast(chunks), _offsets(radius)
    weight = [BASE ** (len(LANES) - 1 - i) for i in range(len(LANES))]
    span = 1 << 16

    def deal(batches: Batches) -> Batches:
        chunks = sent.value
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            key = _tile_key(fps)
            lanes = np.stack([(key // w) % BASE for w in weight])
            own = _chunk(fps, chunks[key])
            groups, roles, values = [], [], []

            def emit(where, tile, i, j, role):
                groups.append((tile * span + i) * span + j)
                roles.append(np.full(len(tile), role, np.int8))
                values.append(fps[where])

            everyone = np.arange(len(fps))
            # as a member: once for each chunk number that visitors may have
            most = chunks[key].astype(np.int64)
            around = []
            for v in near:
                moved = lanes + np.array(v)[:, None]
                ok = ((moved >= 0) & (moved < BASE)).all(axis=0)
                other = np.where(ok, sum(m * w for m, w in zip(moved, weight, strict=True)), key)
                ok &= chunks[other] > 0
                around.append((ok, other))
                most = np.maximum(most, np.where(ok, chunks[other], 0))
            for j in range(int(most.max(initial=0))):
                at = everyone[most > j]
                emit(at, key[at], own[at], np.full(len(at), j), 0)
            # as a visitor of the tiles on the other side of each offset
            for v in near:
                moved = lanes - np.array(v)[:, None]
                ok = ((moved >= 0) & (moved < BASE)).all(axis=0)
                other = np.where(ok, sum(m * w for m, w in zip(moved, weight, strict=True)), key)
                for i in range(int(chunks[other][ok].max(initial=0))):
                    at = everyone[ok & (chunks[other] > i)]
                    emit(at, other[at], np.full(len(at), i), own[at], 1)
            # as a visitor of later chunks of its own tile
            for i in range(1, int(chunks[key].max(initial=0))):
                at = everyone[(chunks[key] > i) & (own < i)]
                emit(at, key[at], np.full(len(at), i), own[at], 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(groups)), pa.array(np.concatenate(roles)), pa.array(np.concatenate(values).view(np.int64))], names=["g", "role", "fp"])

    def compare(batches: Batches) -> Batches:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def solve(parts):
            g, role, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
            cuts = np.nonzero(np.diff(g))[0] + 1
            us, vs = [], []
            for lo, hi in zip([0, *cuts], [*cuts, len(g)], strict=True):
                r, f = role[lo:hi], fp[lo:hi].view(np.uint64)
                members, others = f[r == 0], f[r == 1]
                own = int(g[lo]) % span == (int(g[lo]) // span) % span
                if len(members) and len(members) + len(others) > 1:
                    u, v = _links_of(members, others, own, radius)
                    us.append(u)
                    vs.append(v)
            if us and (u := np.concatenate(us)).size:
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.concatenate(vs).view(np.int64))], names=["u", "v"])

        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if not len(now[0]):
                continue
            # the last group of a batch may go on in the next one
            last = np.searchsorted(now[0], now[0][-1], side="left")
            if last:
                yield from solve([*held, [x[:last] for x in now]])
                held = [[x[last:] for x in now]]
            elif held and held[-1][0][-1] != now[0][0]:
                yield from solve(held)
                held = [now]
            else:
                held.append(now)
        if held:
            yield from solve(held)

    dealt = distinct.select("fp").mapInArrow(deal, "g long, role byte, fp long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(compare, "u long, v long")


def _components(prints: DataFrame, radius: int, links: DataFrame | None) -> DataFrame:
    """(fp, root) of the distinct fingerprints of checkpointed rows (doc_id, h, fp)."""
    classes = cut_lineage(prints.select("fp").distinct())
    near = near_links(classes, radius)
    roots = connected_components(near if links is None else near.union(links))
    return cut_lineage(classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    component_id is the smallest doc_id reachable over links of at most
    ``radius`` differing bits, the row's own included. Null and empty texts, and texts of white
    space, have fingerprint zero and are linked like any other; repeated rows
    and repeated ids stay as they are; where a whole component has null ids,
    component_id is null. An empty table gives an empty result. Other columns are ignored.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col))
    rooted = _components(prints, radius, None)
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    best = rooted.join(first, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(best, "root").select("fp", "component_id")
    return prints.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, links: DataFrame | None = None, prints: DataFrame | None = None) -> DataFrame:
    """One row of each group, with all columns: the smallest id's, nulls last, of equal ids the smallest text hash's.

    Rows without an id take part like all others. Of rows that repeat both the id and the text of a group's first the one whose columns have
    the smallest hash stays; only these rows are exchanged with their texts.
    ``links`` are more links (u, v) between fingerprints of these rows; ``prints`` are checkpointed rows (doc_id, h, fp) of
    these rows, where they are at hand.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col)) if prints is None else prints
    rooted = _components(prints, radius, links)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    first = prints.groupBy("fp").agg(F.min(key).alias("first"))
    best = rooted.join(first, "fp").groupBy("root").agg(F.min("first").alias("first"))
    # a kept key that several rows have; all input columns stay in one struct, so that no name can clash
    counts = prints.groupBy("doc_id", "h").agg(F.count("*").alias("rows"))
    kept = cut_lineage(best.select("first.doc_id", "first.h").alias("k").join(counts.alias("c"), F.col("k.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("k.h") == F.col("c.h"))).select("k.doc_id", "k.h", "rows"))
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("text_hash") == F.col("h"))
    out = keyed.join(kept.where("rows = 1"), same, "left_semi").select("row.*")
    again = kept.where("rows > 1")
    if again.isEmpty():
        return out
    # only rows that repeat a kept one are compared in all their columns
    whole = F.xxhash64(F.to_json("row"))
    one = keyed.join(again.select("doc_id", "h"), same, "left_semi").groupBy("id", "text_hash").agg(F.min_by("row", whole).alias("row"))
    return out.unionByName(one.select("row.*"))

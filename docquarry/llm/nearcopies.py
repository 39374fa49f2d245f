"""Near copies by 5-word Jaccard: MinHash buckets, tiled comparison of sketches, links verified on whole shingle sets.

A pair at similarity s shares one of 24 bands of four minima with probability 1 - (1 - s^4)^24, which is
0.999997 at 0.8. The members of a bucket are compared with exclusive-or and bit counts over two bits of each
of the 96 minima, all with all, in one task (large buckets in chunks, each pair of chunks in a task). Of what is close
enough there, a minimum spanning forest and each member's second choice go on, so a bucket costs its size in candidates and
neither a large group of near copies nor a common passage makes all its pairs. Whether a candidate is a link is
decided by its two whole shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import Batches, Memo, lower_ascii, map_rows, mix
from docquarry.llm.simhash import _SPACES, fingerprint_text
from docquarry.session import cut_lineage

WORDS, BANDS, ROWS = 5, 24, 4
#: Differing minima of 96 (by two bits, so three of four show) up to which a pair is a candidate: 14.4 are expected at 0.8, with a deviation of 3.5.
MOST_DIFFERENT = 26
CHUNK = 16_384
_rng = np.random.default_rng(7)
_FLIP, _TIMES = (_rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)
_LOW_BITS = np.uint64(0x5555555555555555)
_hashes = Memo(lambda w: xxhash.xxh64_intdigest(w, 7))


def shingles(text: str | None) -> np.ndarray:
    """Distinct hashes of the 5-word shingles, sorted; a shorter text is one shingle, one without a word none."""
    words = [w for w in lower_ascii(text or "").translate(_SPACES).split(" ") if w]
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([_hashes[w] for w in words], np.uint64)
    width = min(WORDS, len(h))
    n = len(h) - width + 1
    out = h[:n]
    for k in range(1, width):
        out = mix(out, h[k : n + k], k)
    return np.unique(mix(out, np.full(n, width, np.uint64), 0))


def minima(grams: np.ndarray) -> np.ndarray:
    """The least of each of 96 orders of a non-empty shingle set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(grams), 4096):
            part = (grams[at : at + 4096, None] ^ _FLIP) * _TIMES
            least = np.minimum(least, part.min(axis=0))
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """One hash a band."""
    rows = least.reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = mix(out, rows[:, k], k)
    return out


def sketch(least: np.ndarray) -> bytes:
    """Two bits of each of the minima."""
    with np.errstate(over="ignore"):
        two = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(62)
    words = two.reshape(-1, 32) << np.arange(0, 64, 2, dtype=np.uint64)
    return np.bitwise_or.reduce(words, axis=1).astype("<u8").tobytes()


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, fp, bands, sketch): hash of the text, SimHash fingerprint, bands and sketch of every row; texts without a word have no bands."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))

    def run(cols: dict[str, list]) -> dict[str, list]:
        prints = np.array([fingerprint_text(t) for t in cols["text"]], dtype=np.uint64)
        least = [minima(s) if len(s := shingles(t)) else None for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "h": cols["h"], "fp": prints.view(np.int64), "bands": [[] if x is None else bands(x).view(np.int64) for x in least], "sketch": [None if x is None else sketch(x) for x in least]}

    return map_rows(rows, "doc_id long, h long, fp long, bands array<long>, sketch binary", run)


def candidates(words: np.ndarray, most: int = MOST_DIFFERENT) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group's sketches: a minimum spanning forest over those that differ in ``most`` minima at most, and second choices.

    Distances are worked out row by row as the tree grows, so memory is linear in the group.
    """
    n = len(words)
    best, second = np.full(n, 255, np.uint8), np.full(n, 255, np.uint8)
    parent, other = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left = np.ones(n, bool)
    at, a, b = 0, [], []
    for _ in range(n - 1):
        left[at] = False
        x = words ^ words[at]
        d = np.bitwise_count((x | (x >> np.uint64(1))) & _LOW_BITS).sum(axis=1, dtype=np.uint8)
        closer = d < best
        later = ~closer & (d < second)
        second = np.where(closer, best, np.where(later, d, second))
        other = np.where(closer, parent, np.where(later, at, other))
        best, parent = np.where(closer, d, best), np.where(closer, at, parent)
        at = int(np.where(left, best, 255).argmin())
        if not left[at]:
            at = int(left.argmax())
        for near, node in ((best, parent), (second, other)):
            if near[at] <= most and node[at] != at:
                a.append(at)
                b.append(int(node[at]))
        # a node of the tree is no longer asked for its distance
        best[at] = second[at] = 0
    return np.array(a, np.int64), np.array(b, np.int64)


def _compare(batches: Batches) -> Batches:
    """Rows (bucket, i, j, h, sketch) in group order to candidates (a, b) with a < b."""
    group, hs, marks = None, [], []

    def solve():
        if len(hs) < 2:
            return
        ids = np.array(hs, np.int64)
        a, b = candidates(np.frombuffer(b"".join(marks), "<u8").reshape(len(hs), -1))
        if len(a):
            a, b = ids[a], ids[b]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    for batch in batches:
        for *key, h, mark in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if key != group:
                yield from solve()
                group, hs, marks = key, [], []
            hs.append(h)
            marks.append(mark)
    yield from solve()


def _sets(cols: dict[str, list]) -> dict[str, list]:
    return {"h": cols["h"], "grams": [shingles(t).view(np.int64) for t in cols["text"]]}


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose shingle sets have a Jaccard similarity of 0.8 at least."""
    left, right = (sets.select(F.col("h").alias(x), F.col("grams").alias(f"grams_{x}")) for x in "ab")
    both = F.size("grams_a") + F.size("grams_b")
    # i / (both - i) >= 4 / 5; the lesser set bounds i
    possible = F.least(F.size("grams_a"), F.size("grams_b")) * 9 >= both * 4
    alike = F.when(possible, F.size(F.array_intersect("grams_a", "grams_b")) * 9 >= both * 4)
    return pairs.join(left, "a").join(right, "b").where(alike).select("a", "b")


def near_copy_links(docs: DataFrame, sketched: DataFrame, text_col: str = "text") -> DataFrame:
    """Links (u, v) between the SimHash fingerprints of texts whose 5-word Jaccard similarity is 0.8 at least.

    sketched: the ``sketches`` of the same rows. Of a group of near copies a spanning set of links is given. Texts are
    told apart by a 64-bit hash, so exact copies cost one text; null and word-free texts have no links here.
    """
    distinct = sketched.dropDuplicates(["h"])
    spread = distinct.select("h", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = spread.join(shared, "bucket").join(distinct.select("h", "sketch"), "h")
    parts = F.ceil(F.col("n") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("h", F.lit(3)), parts).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"))))
    dealt = members.select("bucket", pair.alias("__p"), "h", "sketch").select("bucket", "__p.i", "__p.j", "h", "sketch")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = dealt.repartition(tasks, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "h")
    pairs = cut_lineage(grouped.mapInArrow(_compare, "a long, b long").distinct())
    texts = docs.select(F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))
    wanted = texts.join(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "h", "left_semi")
    sets = cut_lineage(map_rows(wanted.dropDuplicates(["h"]), "h long, grams array<long>", _sets))
    links = cut_lineage(_verified(pairs, sets))
    prints = distinct.select("h", "fp")
    named = links.join(prints.select(F.col("h").alias("a"), F.col("fp").alias("u")), "a").join(prints.select(F.col("h").alias("b"), F.col("fp").alias("v")), "b")
    return named.select("u", "v").where("u <> v").distinct()

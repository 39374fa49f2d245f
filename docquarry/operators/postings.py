"""A positional inverted index: written once by Spark, opened by questions stem by stem.

A task inverts its passages in batches of bounded size. What a batch holds of one stem is a segment: the passages, how often and where
it stands in each, all delta-coded in variable-length bytes; places in the header are negative, those in the body begin at 1. A segment
tells the most places that one passage of it has and whether any is in a header, which bounds what a passage of the batch can score.
Stems are dealt to slots by a hash. A row holds a batch's segments of one slot; rows are partitioned by slots and sorted by them, and
partitions of many bytes are cut into several files, so a stem that is everywhere has a segment a batch. A directory, a partition of
its own, holds the keys of each batch's passages and what searches filter by.

A question reads the slots of its own stems. They meet by batch, so a task holds a few rows, the places of passages that have all of
the words are decoded, and batches whose bound is under the k-th score so far are passed over. No text is read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docquarry.functions.stemmer import Stems
from docquarry.functions.text import terms
from docquarry.operators.questions import Literals, parse, stem_of
from docquarry.operators.retrieval import BODY_WEIGHT, HEADER_WEIGHT

BATCH_ROWS, BATCH_CHARS = 4_096, 16_000_000
SLOTS, BUCKETS = 1_024, 64
DIRECTORY = -1  # its bucket
SLICE = 1 << 17  # numbers written at once
ROW = ("stems", "docs", "counts", "places", "sizes", "most")
ROWS = "batch long, slot int, stems string, docs binary, counts binary, places binary, sizes binary, most binary"
_term = re.compile(r"[^\W_]+").findall


def written(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from 0 as bytes of seven bits, low ones first, and where each number ends; worked out by slices, so that little is held beside the result."""
    parts, ends = [np.zeros(0, np.uint8)], np.zeros(len(values), np.int64)
    for at in range(0, len(values), SLICE):
        own = values[at : at + SLICE].astype(np.uint64)
        size = np.ones(len(own), np.int64)
        for k in range(1, 9):
            size += own >= np.uint64(1 << 7 * k)
        stops = np.cumsum(size)
        out = np.zeros(int(stops[-1]), np.uint8)
        starts = stops - size
        for k in range(int(size.max())):
            has = size > k
            more = (size[has] > k + 1).astype(np.uint8) << np.uint8(7)
            out[starts[has] + k] = ((own[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
        ends[at : at + SLICE] = stops + (ends[at - 1] if at else 0)
        parts.append(out)
    return np.concatenate(parts), ends


def read(data: bytes) -> np.ndarray:
    """The numbers that ``written`` wrote."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.nonzero(raw < 128)[0]
    if not len(ends):
        return np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)


def _folded(x: np.ndarray) -> np.ndarray:
    return np.where(x < 0, -2 * x - 1, 2 * x)


def _unfolded(x: np.ndarray) -> np.ndarray:
    return np.where(x % 2 == 1, -(x + 1) // 2, x // 2)


def slot_of(stem: str) -> int:
    return zlib.crc32(stem.encode("utf-8", "surrogatepass")) % SLOTS


class Words:
    """Some passages as the numbers of their stems, four bytes a word; a text isn't held once it is cut."""

    def __init__(self, stems: Stems):
        self.stems, self.numbers = stems, {}
        self.words, self.sizes = array("i"), array("i")

    def add(self, header: str | None, body: str | None) -> None:
        for text in (header, body):
            own = [self.numbers.setdefault(self.stems[t], len(self.numbers)) for t in _term((text or "").lower())]
            self.words.fromlist(own)
            self.sizes.append(len(own))


def invert(headers: list[str | None], bodies: list[str | None], stems: Stems) -> Iterator[tuple]:
    """The segments of some passages."""
    made = Words(stems)
    for header, body in zip(headers, bodies, strict=True):
        made.add(header, body)
    yield from segments(made)


def segments(made: Words) -> Iterator[tuple]:
    """(slot, stems, docs, counts, places, sizes, most) of some passages: the segments of each slot's stems, one after another.

    ``sizes`` are the bytes that a stem has in the three streams; ``most`` is twice the most places of a passage, and one more where any is in a header.
    """
    numbers = made.numbers
    if not numbers:
        return
    names, slots = list(numbers), np.array([slot_of(s) for s in numbers])
    by_slot = np.argsort(slots, kind="stable")
    rank = np.empty(len(names), np.int32)
    rank[by_slot] = np.arange(len(names))
    head, body = np.array(made.sizes, np.int32).reshape(-1, 2).T
    first_body = np.cumsum(head + body) - body
    term, doc = rank[np.frombuffer(made.words, np.int32)], np.repeat(np.arange(len(head), dtype=np.int32), head + body)
    place = np.arange(len(term), dtype=np.int32) - first_body.astype(np.int32)[doc]
    place += place >= 0
    order = np.argsort(term, kind="stable")  # passages and places are in order already
    term = term[order]
    doc = doc[order]
    place = place[order]
    del order
    new_doc = np.concatenate([[True], (np.diff(term) != 0) | (np.diff(doc) != 0)])
    at = np.nonzero(new_doc)[0]
    counts = np.diff(np.append(at, len(term)))
    gaps = np.where(new_doc, _folded(place), np.diff(place, prepend=np.int32(0)))
    post_term, post_doc = term[at], doc[at]
    new_term = np.concatenate([[True], np.diff(post_term) != 0])
    steps = np.where(new_term, post_doc, np.diff(post_doc, prepend=np.int32(0)))
    first_post = np.append(np.nonzero(new_term)[0], len(at))
    first_place = np.append(at[first_post[:-1]], len(term))
    most = 2 * np.maximum.reduceat(counts, first_post[:-1]) + (np.minimum.reduceat(place, first_place[:-1]) < 0)
    raw, cuts = [], []
    for values, firsts in ((steps, first_post), (counts, first_post), (gaps, first_place)):
        data, ends = written(values)
        raw.append(data.tobytes())
        cuts.append(np.concatenate([[0], ends[firsts[1:] - 1]]))
    sizes = np.stack([np.diff(c) for c in cuts], axis=1)
    begin = np.append(np.nonzero(np.diff(slots[by_slot], prepend=-1))[0], len(names)).tolist()
    for a, b in zip(begin, begin[1:], strict=False):
        own = by_slot[a:b].tolist()
        yield (int(slots[own[0]]), "\n".join(names[i] for i in own), *(r[c[a] : c[b]] for r, c in zip(raw, cuts, strict=True)), written(sizes[a:b].ravel())[0].tobytes(), written(most[a:b])[0].tobytes())


def build(passages: DataFrame, path: str, key: Sequence[str], keep: Sequence[str] = (), stem: Callable[[str], str] = stem_of, header_col: str = "header", body_col: str = "content") -> None:
    """Writes the index of all passages: (key, keep, header, body). Null texts have no words; equal keys are passages of their own.

    Each text is cut into words once, each word stemmed once a task. Passages are inverted in the order of their keys, so that a task
    which runs again makes the same batches.
    """
    rows = passages.select(F.struct(*key, *keep).alias("info"), F.col(header_col).cast("string").alias("header"), F.col(body_col).cast("string").alias("body"))
    files = max(1, int(passages.sparkSession.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)  # of a bucket
    kind = to_arrow_schema(rows.select("info").schema).field(0).type
    schema = pa.schema([("batch", pa.int64()), ("slot", pa.int32()), ("stems", pa.string()), *((c, pa.binary()) for c in ROW[1:]), ("info", pa.list_(kind))])

    def run(batches):
        from pyspark import TaskContext

        stems, number = Stems(stem), TaskContext.get().partitionId() << 32
        infos, words, size = [], Words(stems), 0

        def out() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([DIRECTORY], pa.int32()), *(pa.nulls(1, f.type) for f in list(schema)[2:-1]), pa.array([infos], pa.list_(kind))], schema=schema)
            for some in batched(segments(words), 64):
                cols = list(zip(*some, strict=True))
                n = len(cols[0])
                yield pa.RecordBatch.from_arrays([pa.array([number] * n), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:-1], strict=True)), pa.nulls(n, pa.list_(kind))], schema=schema)

        for part in (batch.slice(lo, BATCH_ROWS) for batch in batches for lo in range(0, batch.num_rows, BATCH_ROWS)):
            infos += part.column(0).to_pylist()
            for header, body in zip(part.column(1), part.column(2), strict=True):
                header, body = header.as_py(), body.as_py()
                words.add(header, body)
                size += len(header or "") + len(body or "")
            if len(infos) >= BATCH_ROWS or size >= BATCH_CHARS:
                yield from out()
                number, infos, words, size = number + 1, [], Words(stems), 0
        if infos:
            yield from out()

    made = rows.sortWithinPartitions("info").mapInArrow(run, f"{ROWS}, info array<{rows.schema['info'].dataType.simpleString()}>")
    bucket = F.when(F.col("slot") == DIRECTORY, F.lit(DIRECTORY)).otherwise(F.floor(F.col("slot") / (SLOTS // BUCKETS))).cast("int")
    dealt = made.withColumns({"bucket": bucket, "file": F.pmod(F.xxhash64("batch"), F.lit(files))})
    dealt.repartition("bucket", "file").sortWithinPartitions("bucket", "slot", "batch").drop("file").write.partitionBy("bucket").parquet(path)


def covers(hits: list[tuple[int, int, int, float]], wanted: int, length: int) -> float:
    """The sum over the least spans that hold every literal, from hits (hi, lo, literal, weight) in order."""
    last: dict[int, tuple[int, float]] = {}
    ends: dict[int, tuple[int, float]] = {}
    for hi, lo, literal, weight in hits:
        last[literal] = lo, weight
        if len(last) == wanted:
            begin = min(x for x, _ in last.values())
            end = hi, wanted / sum(1.0 / last[k][1] for k in range(wanted))
            ends[begin] = min(ends.get(begin, end), end)
    return sum(w / (1 + max(0, hi - lo + 1 - length)) for lo, (hi, w) in ends.items())


class _Batch:
    """The segments that a question reads of one batch, by stem; streams are decoded when they are asked for."""

    def __init__(self, rows: list[dict], stems: set[str]):
        self.by_stem: dict[str, dict] = {}
        for row in rows:
            names = row["stems"].split("\n")
            at = [i for i, name in enumerate(names) if name in stems]
            if at:
                ends, most = np.cumsum(read(row["sizes"]).reshape(-1, 3), axis=0), read(row["most"])
                for i in at:
                    lo = ends[i - 1] if i else (0, 0, 0)
                    streams = {c: row[c][lo[k] : ends[i, k]] for k, c in enumerate(("docs", "counts", "places"))}
                    self.by_stem[names[i]] = streams | {"most": int(most[i]) // 2, "head": bool(most[i] % 2)}
        self._docs: dict[str, np.ndarray] = {}
        self._places: dict[str, np.ndarray] = {}

    def docs(self, literal: tuple[str, ...]) -> np.ndarray:
        """Passages with all stems of a literal."""
        out = None
        for s in literal:
            if s not in self._docs:
                self._docs[s] = np.cumsum(read(self.by_stem[s]["docs"])) if s in self.by_stem else np.zeros(0, np.int64)
            out = self._docs[s] if out is None else np.intersect1d(out, self._docs[s], assume_unique=True)
        return out

    def places(self, stem: str) -> np.ndarray:
        """(passage, place) of a stem as one ascending number."""
        if stem not in self._places:
            own, counts = self.by_stem[stem], read(self.by_stem[stem]["counts"])
            gaps, first = read(own["places"]), np.cumsum(counts) - counts
            gaps[first] = _unfolded(gaps[first])
            total = np.cumsum(gaps)
            before = np.repeat(total[first] - gaps[first], counts)
            self._places[stem] = (np.repeat(self.docs((stem,)), counts) << 40) + (total - before) + (1 << 39)
        return self._places[stem]

    def hits(self, literal: tuple[str, ...], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, place) of each place of the passages at which a literal begins."""
        at = self.places(literal[0])
        at = at[np.isin(at >> 40, docs)]
        for k, s in enumerate(literal[1:], 1):
            at = at[np.isin(at + k, self.places(s), assume_unique=True)]
        return at >> 40, (at & ((1 << 40) - 1)) - (1 << 39)

    def bound(self, want: Literals) -> float:
        """More than this no passage can score: its hits at most, all in the side that weighs most."""
        if any(s not in self.by_stem for literal in want.must for s in literal):
            return 0.0
        own = [self.by_stem[s] for literal in want.must for s in literal]
        hits = sum(min(self.by_stem[s]["most"] for s in literal) for literal in want.must)
        return hits * (HEADER_WEIGHT if any(s["head"] for s in own) else BODY_WEIGHT)

    def scores(self, want: Literals) -> dict[int, float]:
        docs = None
        for literal in want.must:
            own = self.docs(literal)
            docs = own if docs is None else np.intersect1d(docs, own, assume_unique=True)
            if not len(docs):
                return {}
        found = [(k, *self.hits(literal, docs)) for k, literal in enumerate(want.must)]
        for _, own, _ in found:
            docs = np.intersect1d(docs, own)
        for literal in want.must_not:
            some = np.intersect1d(docs, self.docs(literal), assume_unique=True)
            if len(some):
                docs = np.setdiff1d(docs, self.hits(literal, some)[0])
        by_doc: dict[int, list[tuple[int, int, int, float]]] = {d: [] for d in docs.tolist()}
        for k, own, places in found:
            for d, lo in zip(own.tolist(), places.tolist(), strict=True):
                if d in by_doc:
                    by_doc[d].append((lo + len(want.must[k]) - 1, lo, k, HEADER_WEIGHT if lo < 0 else BODY_WEIGHT))
        return {d: covers(sorted(hits), len(want.must), sum(map(len, want.must))) for d, hits in by_doc.items()}


def opened(spark: SparkSession, path: str, stems: Sequence[str], info: str) -> DataFrame:
    """The rows with some stems, and those of the directory: their partitions, and what the files' statistics leave of these."""
    slots = sorted({slot_of(s) for s in stems})
    buckets = sorted({s // (SLOTS // BUCKETS) for s in slots})
    return spark.read.schema(f"{ROWS}, info {info}, bucket int").parquet(path).where(F.col("bucket").isin(DIRECTORY, *buckets) & F.col("slot").isin(DIRECTORY, *slots))


def _best(batches: Iterator[pa.RecordBatch], wants: Sequence[Literals], stems: set[str], k: int, key: Sequence[str]) -> list[tuple]:
    """The k best (-score, key as (there, value) pairs) of batches with a row (rows, keys) each; one is decoded at a time, and of its keys those of hits."""
    best: list[tuple] = []
    for batch in batches:
        for held, info in zip(batch.column(0), batch.column(1), strict=True):
            own = _Batch(held.as_py(), stems)
            if len(best) == k and round(sum(own.bound(w) for w in wants), 9) < -best[-1][0]:
                continue
            total: dict[int, float] = {}
            for want in wants:
                for d, s in own.scores(want).items():
                    total[d] = total.get(d, 0.0) + s
            keys = info.values.take(pa.array(list(total), pa.int64())).to_pylist()
            rows = [(-round(s, 9), tuple((x[c] is not None, x[c]) for c in key)) for x, s in zip(keys, total.values(), strict=True) if x is not None]
            best = sorted([*best, *rows])[:k]
    return best


def question_pool(passages: DataFrame, path: str, question: str, k: int, key: Sequence[str], keep: Sequence[str] = (), where: Callable[[Column], Column] | None = None, stem: Callable[[str], str] = stem_of) -> DataFrame:
    """The k best (key, text_score, text_rank) of the passages that answer at least one alternative; equal scores go by key.

    ``where`` makes a condition of a passage's entry in the directory. key, keep and ``stem`` must be those that the index was
    built with; of ``passages`` only the types of these columns are read.
    """
    spark, wants = passages.sparkSession, parse(question, stem=stem)
    kinds = [passages.schema[c] for c in key]
    if not wants:
        return spark.createDataFrame([], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", text_score double, text_rank int")
    stems = {s for w in wants for literal in (*w.must, *w.must_not) for s in literal}
    rows = opened(spark, path, sorted(stems), f"array<{passages.select(F.struct(*key, *keep).alias('i')).schema['i'].dataType.simpleString()}>")
    allowed = F.transform("info", lambda r: F.when(where(r) if where else F.lit(True), F.struct(*[r[c].alias(c) for c in key])))
    # a batch's directory entry and its rows of the question's slots
    meet = rows.groupBy("batch").agg(F.collect_list(F.when(F.col("slot") >= 0, F.struct(*ROW))).alias("rows"), F.first(F.when(F.col("slot") == DIRECTORY, allowed), ignorenulls=True).alias("info"))
    both = meet.where(F.size("rows") > 0).select("rows", "info")

    def run(batches):
        best = _best(batches, wants, stems, k, key)
        cols = [pa.array([r[1][i][1] for r in best], f.type) for i, f in enumerate(arrow)] + [pa.array([-r[0] for r in best], pa.float64())]
        yield pa.RecordBatch.from_arrays(cols, names=[*key, "text_score"])

    arrow = list(to_arrow_schema(StructType(kinds)))
    order = (F.desc("text_score"), *key)
    found = both.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", text_score double").orderBy(*order).limit(k)
    return found.withColumn("text_rank", F.row_number().over(Window.orderBy(*order)))


def corpus_stems(texts: DataFrame, text_col: str, stem: Callable[[str], str]) -> DataFrame:
    """(term, stem, n_documents) of the distinct terms of all texts: each is stemmed once, whatever number of texts has it."""
    found = texts.select(F.explode(F.array_distinct(terms(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count("*").alias("n_documents"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([stem(t) for t in batch.column(0).to_pylist()], pa.string()), batch.column(1)], names=["term", "stem", "n_documents"])

    return found.select("term", "n_documents").mapInArrow(run, "term string, stem string, n_documents long")

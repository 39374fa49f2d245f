"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the hashed words, word stems (leading letters), word
pairs and skip-grams (pairs with one or two words between) that occur in it.
The learner keeps a rate for each coordinate and an L1 term, so that most weights are exactly
zero; the others are a small table that is broadcast to score every text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import Batches, WordRows, crc_mod, map_rows, mix

DIM_BITS = 22
#: At most about this many labelled rows are learned from; they are picked by a hash of their id.
MAX_EXAMPLES = 8_000
EPOCHS = 3
#: Without examples every text scores as this bias does, 0.25.
UNKNOWN = float(np.log(1 / 3))
STEMS = (5, 7)
_words = regex.compile(r"[\p{L}\p{N}]+").findall


def _hash(text: str, salt: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"), salt) * 0x9E3779B97F4A7C15 & (1 << 64) - 1


def _word_rows(words: list[str]) -> np.ndarray:
    return np.array([(_hash(w, 1), *(_hash(w[:n], 2 + n) for n in STEMS)) for w in words], dtype=np.uint64)


_rows = WordRows(_word_rows)


def _numbers(text: str | None) -> np.ndarray:
    """Feature numbers of all places of a text, repeats included."""
    words = _words((text or "").lower())
    if not words:
        return np.zeros(0, np.uint32)
    h = _rows.rows(words)
    word = np.ascontiguousarray(h[:, 0])
    parts = [h.ravel(), *(mix(word[:-gap], word[gap:], gap) for gap in (1, 2, 3))]
    return np.concatenate([(x >> np.uint64(64 - DIM_BITS)).astype(np.uint32) for x in parts])


def features(text: str | None) -> np.ndarray:
    """Distinct feature numbers of a text; a null text has none."""
    return np.unique(_numbers(text)).astype(np.int64)


class Scorer:
    """The broadcast weights as a table of one Python worker's task."""

    def __init__(self, weights: tuple[np.ndarray, np.ndarray, float]):
        f, w, self.bias = weights
        self.table = np.zeros(1 << DIM_BITS, np.float32)
        self.table[f] = w
        self.live = self.table != 0

    def __call__(self, text: str | None) -> float:
        numbers = _numbers(text)
        some = np.unique(numbers[self.live[numbers]])
        return float(1.0 / (1.0 + np.exp(-np.clip(self.table[some].sum(dtype=np.float64) + self.bias, -35, 35))))


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature, weight, bias) after a few passes in the given order."""
    return learned(x for _ in range(epochs) for x in zip(rows, labels, strict=True))


def learned(examples: Iterable[tuple[np.ndarray, float]], alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature, weight, bias) after the examples (features, label) in the given order, of which one is held at a time."""
    z, n = np.zeros(1 << DIM_BITS), np.zeros(1 << DIM_BITS)
    bias_z = bias_n = bias = 0.0
    for x, y in examples:
        zx, nx = z[x], n[x]
        w = np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((beta + np.sqrt(nx)) / alpha + l2))
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
        z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / alpha * w
        n[x] = nx + g * g
        bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha * bias
        bias_n += g * g
        bias = -bias_z / ((beta + np.sqrt(bias_n)) / alpha)
    some = np.nonzero(np.abs(z) > l1)[0]
    return some, -(z[some] - np.sign(z[some]) * l1) / ((beta + np.sqrt(n[some])) / alpha + l2), float(bias)


def train(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from the labelled rows that aren't held out, a bounded sample of them.

    An id is one example: of several labels the highest counts, of several texts the one of the smallest hash, so that
    the sample is bounded whatever repeats. Features are made where the texts are, all of an example; one task then learns from them as
    they stream by EPOCHS times in hash order, so the same rows give the same weights. It holds a batch of examples and the weights' table. Rows with null labels or
    ids are left out. Without examples all scores are 0.25.
    """
    nothing = np.zeros(0, np.int64), np.zeros(0), UNKNOWN
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) != 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    count = usable.count()
    if not count:
        return nothing
    spread = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1 << 30))
    picked = usable.where(spread < int(min(1.0, max_examples / count) * (1 << 30))).withColumn("spread", spread)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hit = texts.join(F.broadcast(picked), "doc_id")  # about max_examples rows
    sample = hit.groupBy("doc_id", "spread", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def feature_rows(cols: dict[str, list]) -> dict[str, list]:
        return {"spread": cols["spread"], "y": [float(x > 0) for x in cols["toxic"]], "x": [features(t).astype(np.int32) for t in cols["text"]]}

    rows = map_rows(sample.select("spread", "toxic", "text"), "spread long, y double, x array<int>", feature_rows)

    def learn(batches: Batches) -> Batches:
        some = False

        def examples() -> Iterator[tuple[np.ndarray, float]]:
            nonlocal some
            for batch in batches:
                column = batch.column(2)
                flat, at = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
                for y, a, b in zip(batch.column(1).to_pylist(), at, at[1:], strict=False):
                    some = True
                    yield flat[a:b], y

        f, w, bias = learned(examples())
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(f, -1)), pa.array(np.append(w, bias))], names=["f", "w"])

    epochs = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))))
    got = epochs.repartition(1).sortWithinPartitions("epoch", "spread", "y", F.size("x")).select("spread", "y", "x").mapInArrow(learn, "f long, w double").toPandas()
    if not len(got):
        return nothing
    f, w = got["f"].to_numpy(), got["w"].to_numpy()
    return f[f >= 0], w[f >= 0], float(w[f < 0][0])


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(doc_id, score, predicted) of every row; null and empty texts score as the bias does alone."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    scorer: list[Scorer] = []

    def run(cols: dict[str, list]) -> dict[str, list]:
        if not scorer:
            scorer.append(Scorer(sent.value))
        scores = np.array([scorer[0](t) for t in cols["text"]])
        return {"doc_id": cols["doc_id"], "score": scores, "predicted": (scores >= 0.5).astype(np.int32)}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id long, score double, predicted int", run)


def toxicity(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row.

    Labels, language, source and id are no features. Rows of any text length
    are scored whole; other columns are ignored; an empty table gives an empty result.
    """
    scored = score(docs, train(docs, labels, max_examples))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with all their columns; nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_examples))
    at = docs.columns.index("text")

    def run(batches: Batches) -> Batches:
        scorer = Scorer(sent.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

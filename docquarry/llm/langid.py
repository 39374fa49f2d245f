"""Language identification by error-correcting output codes.

Each language gets a codeword of bits that differs from every other one in
many places. One binary naive Bayes classifier over hashed character n-grams
of words (n = 1 to 4, word ends marked) predicts each bit. A text's bits are
soft: the mean evidence for each over all its n-grams. Decoding adds up, for
every codeword, each bit's loss times that bit's reliability and takes the
nearest codeword; a text whose two nearest are about as near is ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import Batches, WordRows, crc_mod, map_rows

DIM_BITS = 16
ORDERS = (1, 2, 3, 4)
#: About this many distinct texts of each language, picked by their hash, are learned from.
EXAMPLES_PER_LANGUAGE = 1_500
#: Languages whose counts one task holds before it hands them on.
HELD_LANGUAGES = 64
UNDETERMINED = "und"
#: Loss units between the two nearest codewords below which a text is ambiguous.
AMBIGUOUS_GAP = 0.02
_words = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: the exhaustive code for up to 7 languages, else seeded rows far apart."""
    if n <= 2:
        return np.array([[1], [-1]])[:n]
    if n <= 7:
        # all columns that split the languages, one of each complement pair
        return np.array([[1, *c] for c in product((1, -1), repeat=n - 1) if -1 in c]).T
    rng, width = np.random.default_rng(7), 15 + 6 * int(np.ceil(np.log2(n)))
    best = max((rng.choice([-1, 1], size=(n, width)) for _ in range(50)), key=lambda m: ((width - m @ m.T) // 2 + width * np.eye(n, dtype=int)).min())
    return best[:, (best.min(axis=0) < 0) & (best.max(axis=0) > 0)]


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of many words, and where each word's begin."""
    text = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word_of = np.repeat(np.arange(len(words)), length)
    numbers, owners = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in ORDERS:
        last = len(codes) - n + 1
        if last <= 0:
            break
        with np.errstate(over="ignore"):
            h = (h[:last] * np.uint64(0x100000001B3)) ^ (codes[n - 1 : n - 1 + last] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        inside = word_of[:last] == word_of[n - 1 : n - 1 + last]
        numbers.append((x >> np.uint64(64 - DIM_BITS))[inside].astype(np.int64))
        owners.append(word_of[:last][inside])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(numbers)[order], np.searchsorted(owner[order], np.arange(len(words)))


@dataclass
class Model:
    """Bounded by 2**DIM_BITS x code width, which grows with the logarithm of the number of languages."""

    languages: list[str]
    codes: np.ndarray  # languages x bits
    weights: np.ndarray  # n-grams x bits
    reliability: np.ndarray  # bits


def train(docs: DataFrame, per_language: int = EXAMPLES_PER_LANGUAGE) -> Model:
    """Learned from text and non-null language of the documents that aren't held out.

    Equal texts of a language count once, in the share that is drawn and in the sample, so copies push nothing out. Counts of n-grams are summed on the
    executors; at most 2**DIM_BITS rows a language come back.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", 3) != 1)).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    hashed = usable.select("lang", "text", F.xxhash64("text").alias("h"))
    found = {r["lang"]: r["n"] for r in hashed.groupBy("lang", "h").agg(F.lit(1).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(found)
    if not languages:
        return Model([], codewords(0), np.zeros((1 << DIM_BITS, 1), np.float32), np.ones(1))
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(int(min(1.0, per_language / found[k]) * (1 << 30))))])
    spread = F.pmod(F.xxhash64(F.col("h"), F.lit(11)), F.lit(1 << 30))
    sample = hashed.where(spread < F.element_at(share, F.col("lang"))).dropDuplicates(["lang", "h"]).select("lang", "text")
    at = {k: i for i, k in enumerate(languages)}

    def count(batches: Batches) -> Batches:
        total: dict[int, np.ndarray] = {}

        def told() -> pa.RecordBatch:
            rows = [(i, (some := np.nonzero(n)[0]), n[some]) for i, n in total.items()]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*((np.full(len(f), i), f, n) for i, f, n in rows), strict=True)], names=["i", "f", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if words := _words(text.lower()):
                    if at[lang] not in total and len(total) >= HELD_LANGUAGES:
                        yield told()
                        total.clear()
                    grams = np.bincount(word_grams(words)[0], minlength=1 << DIM_BITS)
                    total[at[lang]] = total[at[lang]] + grams if at[lang] in total else grams
        if total:
            yield told()

    table = np.zeros((len(languages), 1 << DIM_BITS), np.float32)
    got = sample.mapInArrow(count, "i long, f long, n long").groupBy("i", "f").agg(F.sum("n").alias("n")).toPandas()
    table[got["i"].to_numpy(np.int64), got["f"].to_numpy(np.int64)] = got["n"].to_numpy(np.float32)
    # each language counts alike in the two sides of a bit
    rates = table / np.maximum(1.0, table.sum(axis=1, keepdims=True, dtype=np.float64)).astype(np.float32)
    codes, smooth = codewords(len(languages)), 1e-6
    weights = np.zeros((1 << DIM_BITS, codes.shape[1]), np.float32)
    reliability = np.ones(codes.shape[1])
    for b in range(codes.shape[1]):
        side = codes[:, b] > 0
        if side.all() or not side.any():
            continue
        weights[:, b] = np.log((rates[side].mean(axis=0, dtype=np.float64) + smooth) / (rates[~side].mean(axis=0, dtype=np.float64) + smooth))
        # separation of the two sides' mean evidence, in the units of the loss
        reliability[b] = max(0.1, float((rates[side] @ weights[:, b]).mean() - (rates[~side] @ weights[:, b]).mean()) / 2)
    return Model(languages, codes, weights, reliability / reliability.max())


class Classifier:
    """A broadcast model with the word evidence that one task has worked out."""

    def __init__(self, model: Model):
        self.model = model
        self.evidence = WordRows(self._evidence, 200_000)

    def _evidence(self, words: list[str]) -> np.ndarray:
        grams, starts = word_grams(words)
        sums = np.add.reduceat(self.model.weights[grams], starts, axis=0)
        return np.column_stack([sums, np.diff(np.append(starts, len(grams)))]).astype(np.float32)

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score between 0 and 1, and whether it is ambiguous."""
        m = self.model
        words = _words((text or "").lower())
        if not words or not m.languages:
            return UNDETERMINED, 0.0, not words
        total = self.evidence.rows(words).sum(axis=0, dtype=np.float64)
        bits = total[:-1] / max(1.0, total[-1])
        loss = (np.log1p(np.exp(-m.codes * bits * 4)) * m.reliability).sum(axis=1) / m.reliability.sum()
        order = np.argsort(loss, kind="stable")
        near = np.exp(-(loss - loss[order[0]]) * 4)
        gap = float(loss[order[1]] - loss[order[0]]) if len(order) > 1 else 1.0
        return m.languages[order[0]], float(1.0 / near.sum()), gap < AMBIGUOUS_GAP


def identify(docs: DataFrame, per_language: int = EXAMPLES_PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous), one row per input row.

    lang_pred is a learned language, or "und" with score 0 where the text is null or has no
    letter, or where there was nothing to learn from; only the former is ambiguous. Ties go to the language that sorts first. Texts are
    read whole; language, source and id are no inputs of a prediction; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, per_language))
    ready: list[Classifier] = []

    def run(cols: dict[str, list]) -> dict[str, list]:
        if not ready:
            ready.append(Classifier(sent.value))
        lang, score, ambiguous = zip(*map(ready[0], cols["text"]), strict=True) if cols["text"] else ((), (), ())
        return {"doc_id": cols["doc_id"], "lang_pred": lang, "score": score, "ambiguous": ambiguous}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = map_rows(rows, "doc_id long, lang_pred string, score double, ambiguous boolean", run)
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame, per_language: int = EXAMPLES_PER_LANGUAGE) -> DataFrame:
    """The documents with a language that isn't ambiguous, with all their columns; nothing is shuffled.

    Where there was nothing to learn from, all that have a letter stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, per_language))
    at = docs.columns.index("text")

    def run(batches: Batches) -> Batches:
        classify = Classifier(sent.value)
        for batch in batches:
            yield batch.filter(pa.array([not classify(t)[2] for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

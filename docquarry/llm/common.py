"""Small helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def lower_ascii(text: str) -> str:
    """A-Z to a-z, all else as it is."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def map_rows(df: DataFrame, schema: str, fn: Callable[[dict[str, list]], dict[str, Iterable]]) -> DataFrame:
    """mapInArrow over column lists: ``fn`` gets and returns a dict of equally long columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            out = fn({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type, from_pandas=False) for f in kinds], schema=kinds)

    return df.mapInArrow(run, schema)


class Memo(dict):
    """Word memo of one Python worker, emptied at ``limit`` entries and without words over ``longest`` characters, so that memory stays bounded."""

    def __init__(self, make: Callable[[str], object], limit: int = 300_000, longest: int = 1 << 30):
        super().__init__()
        self._make, self._limit, self._longest = make, limit, longest

    def __missing__(self, word):
        made = self._make(word)
        if len(word) <= self._longest:
            if len(self) >= self._limit:
                self.clear()
            self[word] = made
        return made


def mix(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """Order-sensitive 64-bit combination of two hash arrays."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15 + 2 * salt) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


class WordRows(dict):
    """Words to rows of one array, made in batches; emptied between texts once ``limit`` words are held."""

    def __init__(self, make: Callable[[list[str]], np.ndarray], limit: int = 300_000):
        super().__init__()
        self._make, self._limit = make, limit
        self._fresh: list[str] = []
        self._rows: np.ndarray | None = None

    def __missing__(self, word):
        self[word] = at = len(self)
        self._fresh.append(word)
        return at

    def rows(self, words: list[str]) -> np.ndarray:
        """One row for each word, in order; ``words`` isn't empty."""
        if len(self) >= self._limit:
            self.clear()
            self._rows = None
        at = np.array([self[w] for w in words])
        if self._fresh:
            new, n = self._make(self._fresh), len(self) - len(self._fresh)
            if self._rows is None or len(self) > len(self._rows):
                grown = np.empty((2 * len(self) + 1024, *new.shape[1:]), new.dtype)
                if n:
                    grown[:n] = self._rows[:n]
                self._rows = grown
            self._rows[n : n + len(new)] = new
            self._fresh = []
        return self._rows[at]

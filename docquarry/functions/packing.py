"""Greedy packing as Arrow functions over arrays of token counts.

The counts are made by JVM expressions; only integers come here. A group's end
is found by a search in the running sum, so a document costs its groups, not
its units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _end(total: np.ndarray, start: int, limit: float) -> int:
    """Where a greedy group from ``start`` ends (exclusive); ``total`` is the running sum of the costs."""
    before = total[start - 1] if start else 0
    return max(start + 1, int(np.searchsorted(total, before + limit, side="right")))


def group_ends(costs: np.ndarray, limit: int) -> list[int]:
    """Ends (exclusive) of greedy groups of at most ``limit``; a larger unit stands alone."""
    total, ends = np.cumsum(costs), [0]
    while ends[-1] < len(total):
        ends.append(_end(total, ends[-1], limit))
    return ends[1:]


def chunk_ranges(costs: np.ndarray, alone: np.ndarray, limit: int, repeat: Callable[[int, int], int]) -> Iterator[tuple[int, int]]:
    """Ranges of units that make a chunk each: an ``alone`` unit by itself, others greedily up to the limit.

    ``repeat(lo, hi)`` is what the chunk after lo..hi begins with again, and returns its cost. Nothing is repeated next to an alone unit.
    """
    total, walls = np.cumsum(costs), np.append(np.nonzero(alone)[0], len(costs))
    at = spent = 0
    for wall in walls.tolist():
        while at < wall:
            end = min(_end(total, at, limit - spent), wall)
            yield at, end
            spent = repeat(at, end) if end < wall else 0
            at = end
        if wall < len(costs):
            yield wall, wall + 1
        at, spent = wall + 1, 0


def tail_units(costs: np.ndarray, budget: int) -> int:
    """Units to keep from the end: one at least, more while they fit and the budget isn't met."""
    if budget <= 0 or not len(costs):
        return 0
    total = np.cumsum(costs[::-1])
    fit = int(np.searchsorted(total, budget, side="right"))
    met = int(np.searchsorted(total, budget, side="left")) + 1
    return min(max(1, fit), met, len(costs))


def pack_ends(costs: Column, limit: int) -> Column:
    def ends(costs: pd.Series) -> pd.Series:
        return pd.Series([group_ends(np.asarray(c, np.int64), limit) if c is not None else None for c in costs], dtype=object)

    return F.pandas_udf(ends, "array<int>")(costs)


def tail_count(costs: Column, budget: int) -> Column:
    def tail(costs: pd.Series) -> pd.Series:
        return pd.Series([tail_units(np.asarray(c, np.int64), budget) if c is not None else 0 for c in costs], dtype="int32")

    return F.pandas_udf(tail, "int")(costs)


def grouped(units: Column, ends: Column) -> Column:
    """Units cut into arrays at the ends."""
    return F.transform(ends, lambda end, i: F.slice(units, F.coalesce(F.get(ends, i - 1), F.lit(0)) + 1, end - F.coalesce(F.get(ends, i - 1), F.lit(0))))

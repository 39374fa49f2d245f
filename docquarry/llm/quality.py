"""Quality rules: a table of thresholds compiled into one projection.

Everything is built-in DataFrame functions over the text column; there is no
shuffle and no user function. Repeated 8-word windows are found in the row:
each window's hash is put in the high bits of a long, its place in the low
ones, the longs are sorted, and neighbours with equal hashes are then compared
by their words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
PLACE_BITS = 22  # places in a text; longer texts take the wide path below

#: The rules: measure, least and most allowed value (None: no bound).
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 20, 200_000),
    ("mean_word_chars", 2.0, 15.0),
    ("symbol_ratio", None, 0.2),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
    ("mean_line_words", 1.5, None),
)

#: Frequent short words of English, French, German and Spanish.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "le", "la", "les", "de", "des", "et", "en", "un", "der", "die", "das", "und", "den", "von", "zu", "mit", "el", "los", "las", "que", "del", "y")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _window_hash(hashes: Column, i: Column) -> Column:
    """Hash of the window that starts at i (from 1); slice() would copy the whole array each time."""
    return F.xxhash64(*(F.get(hashes, i + (k - 1)) for k in range(WINDOW)))


def _windows(hashes: Column) -> tuple[Column, Column]:
    """Hash and place of each window in hash order: packed in longs, or as structs for the longest texts."""
    n, low = F.size(hashes), (1 << PLACE_BITS) - 1
    starts = F.sequence(F.lit(1), n - (WINDOW - 1))
    packed = F.transform(starts, lambda i: _window_hash(hashes, i).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
    return F.when((n >= WINDOW) & (n <= low), F.sort_array(packed)), F.when(n > low, F.array_sort(F.transform(starts, lambda i: F.struct(_window_hash(hashes, i).alias("h"), i.cast("long").alias("i")))))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input with the columns of the contract and the ratios the rules read.

    A null text has no words: all counts are 0 and so are the ratios. Texts of
    any length are measured whole. Input columns with the names of measures are replaced, all others kept.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    low = (1 << PLACE_BITS) - 1
    words = F.col("__words")
    word = lambda i, k: F.get(words, i.cast("int") + (k - 1))
    same_words = lambda a, b: reduce(lambda x, y: x & y, [word(a, k) == word(b, k) for k in range(WINDOW)])
    narrow, wide = _windows(F.col("__hashes"))

    def repeats(xs: Column, h, i) -> Column:
        """Places whose neighbour in hash order has the same words."""
        n = F.size(xs)
        match = lambda x, k: (h(x) == h(F.get(xs, k))) & same_words(i(x), i(F.get(xs, k)))
        found = F.filter(xs, lambda x, k: ((k > 0) & match(x, k - 1)) | ((k < n - 1) & match(x, k + 1)))
        return F.sort_array(F.transform(found, i))

    bits = F.lit(~low)
    places = F.coalesce(
        repeats(F.col("__packed"), lambda x: x.bitwiseAND(bits), lambda x: x.bitwiseAND(F.lit(low))),
        repeats(F.col("__wide"), lambda x: x["h"], lambda x: x["i"]),
        F.array().cast("array<long>"),
    )
    at = F.col("__places")
    covered = F.aggregate(
        at,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).cast("long").alias("last")),
        lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW).cast("long"), p - s["last"])).alias("n"), p.alias("last")),
        lambda s: s["n"],
    )
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n_words = F.col("n_words")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    stop = F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS)))
    steps = [
        {"__words": _words(text), "__lines": lines},
        {"__hashes": F.transform("__words", lambda w: F.xxhash64(w))},
        {"__packed": narrow, "__wide": wide},
        {"__places": places},
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.when(F.size("__places") > 0, covered).otherwise(F.lit(0)).cast("long"),
            "__n_lines": F.size("__lines"),
            "__n_stop": stop,
        },
        {
            "mean_word_chars": ratio(F.col("word_chars"), n_words),
            "symbol_ratio": ratio(F.col("n_symbols"), F.col("word_chars")),
            "stop_word_ratio": ratio(F.col("__n_stop"), n_words),
            "dup_line_ratio": ratio(F.col("n_dup_lines"), F.col("__n_lines")),
            "mean_line_words": ratio(n_words, F.col("__n_lines")),
        },
    ]
    made = [c for step in steps for c in step]
    shown = [c for c in made if not c.startswith("__")]
    clash = [c for c in docs.columns if c in made and c not in shown]
    aside = f"__kept_{len(docs.columns)}_{'_'.join(clash)}"
    # input columns with the names of steps wait in a struct of their own
    rest = [c for c in docs.columns if c not in shown and c not in clash or c == text_col]
    out = docs.select(*[F.col(f"`{c}`") for c in rest], *([F.struct(*[F.col(f"`{c}`") for c in clash]).alias(aside)] if clash else []))
    for step in steps:
        out = out.withColumns(step)
    own = {c: F.col(f"`{aside}`.`{c}`") for c in clash}
    return out.select(*[own.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns if c in clash or c in rest], *[c for c in shown if c != text_col])


def verdict(rules=RULES) -> Column:
    """The table as one predicate."""
    bounds = [F.col(name) >= least for name, least, _ in rules if least is not None] + [F.col(name) <= most for name, _, most in rules if most is not None]
    return reduce(lambda a, b: a & b, bounds, F.lit(True))


def apply_rules(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The input with measures, ``base_failed`` and ``kept``; one row per input row.

    base_failed: under 20 words, or over 30 of 100 words in repeated windows.
    kept: not base_failed and within all bounds of the table. Null and empty texts fail.
    """
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return measures(docs.drop("base_failed", "kept"), text_col).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))

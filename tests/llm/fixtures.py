"""Documents with the odd cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, fp long, labels string"


def docs(spark, texts, first=1):
    rows = [(i, t, "en", "s", 0, 0.5, 1, 1, "x") for i, t in enumerate(texts, first)]
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark):
    long = " ".join(f"word{i % 977} and" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (5, "one two three four five"), (6, long), (None, "no id here"), (7, "Ünïcode ΣΑΣ 日本語 🙂 é"), (8, "a" * 5000), (9, "123 !!! ###")]
    return spark.createDataFrame([(*r, None, "s", None, None, None, None, None) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

"""Exact dedup by progressive refinement: lengths first, then hashes of prefixes, then whole hashes.

Rows whose length no other row has are unique and need no hash. Of the rest, those whose prefix hash no other row of that
length has are unique too. Only what is left is hashed whole, and only these rows are exchanged by their hash.

Which rows go on is told by slots: the keys that two or more rows share are hashed to SLOTS numbers, of which the
distinct ones are broadcast. So the broadcast is bounded whatever the corpus; a row that gets on by a slot that another key
set is hashed once too often and turns out unique. Texts never leave the tasks that read them.

Groups that hold more than one row of HOT_SHARE are so few that they can be broadcast; smaller groups meet their rows in
an exchange by hash, where no key can be hot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.session import cut_lineage

SLOTS = 1 << 20
PREFIX_CHARS = 64
HOT_SHARE = 20_000
BLANKS = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    """The text without blanks; null is empty."""
    return reduce(lambda t, blank: F.replace(t, F.lit(blank), F.lit("")), BLANKS, F.coalesce(text.cast("string"), F.lit("")))


def _slot(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SLOTS))


def _shared(rows: DataFrame, *keys: str) -> DataFrame:
    """(slot) of the keys that two or more rows have: SLOTS rows at most."""
    return cut_lineage(rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(_slot(*keys).alias("slot")).distinct())


def exact_duplicates(docs: DataFrame, digest_all: bool = False) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest), one row an input row.

    Rows are a group if their texts are equal once all blanks are deleted; null and blank texts are equal to the empty one. The
    row with the most characters before that stays, of these the one with the smallest id, null ids last; of rows equal in both, one.
    ``digest`` is the SHA-256 of the text without blanks where a row had to be hashed whole, of all rows if asked for; else null.
    Rows that repeat an id are rows of their own; other columns are ignored; an empty table gives an empty result.
    """
    bare = normalised(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("points"), bare.alias("bare"))
    rows = rows.withColumn("size", F.octet_length("bare").cast("long"))
    lengths = _shared(rows, "size")
    prefix = F.xxhash64(F.substring("bare", 1, PREFIX_CHARS)).alias("prefix")
    keyed = rows.join(F.broadcast(lengths), _slot("size") == lengths["slot"], "left_semi").select("size", prefix)
    prefixes = _shared(keyed, "size", "prefix")
    open_lengths, open_prefixes = (F.broadcast(s.select(F.col("slot").alias(name))) for s, name in ((lengths, "by_length"), (prefixes, "by_prefix")))
    marked = rows.withColumn("prefix", prefix).join(open_lengths, _slot("size") == F.col("by_length"), "left").join(open_prefixes, _slot("size", "prefix") == F.col("by_prefix"), "left")
    still_open = F.col("by_length").isNotNull() & F.col("by_prefix").isNotNull()
    digest = F.sha2("bare", 256) if digest_all else F.when(still_open, F.sha2("bare", 256))
    narrow = cut_lineage(marked.select("doc_id", "points", still_open.alias("open"), digest.alias("digest")))
    unique = narrow.where("NOT open").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    # rows equal in all that counts are one row with a number
    hashed = narrow.where("open").groupBy("digest", "doc_id", "points").agg(F.count("*").alias("rows"))
    first = F.min(F.struct((-F.col("points")).alias("most"), F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("first")
    groups = cut_lineage(hashed.groupBy("digest").agg(F.sum("rows").alias("group_size"), first))
    hot = groups.where(F.col("group_size") > max(1_000, narrow.count() // HOT_SHARE))  # at most HOT_SHARE groups
    some = hashed.join(F.broadcast(hot), "digest").unionByName(hashed.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(groups, "digest"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("points") == -F.col("first.most"))
    each = some.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return each.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (stays & (F.col("copy") == 1)).alias("kept"), "digest").unionByName(unique)

"""License scans by diagonal voting.

All rolling word k-grams of a text are hashed. A hash that a template also has
at some position votes for the diagonal "place in the text minus place in the
template". Spark joins the hashes to the template positions and counts the
votes by diagonal; neighbouring diagonals, which an inserted or left-out
word makes, are merged; a merged run's span is then verified: it must not be much longer than the template, and
enough of the template must stand in it in the template's order.

Only hashes that a small bit table of the templates may hold leave the Python
task, with the words they stand for; the join then compares hash and words,
which verifies each vote. A phrase has to stand whole on one diagonal.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import Batches, WordRows, lower_ascii, mix
from docquarry.session import cut_lineage

K = 3
TABLE_BITS = 18
#: Diagonals at most this far apart are merged.
GAP = 4
#: Share of a template's k-grams that must be on a merged run.
COVERAGE = 0.6
#: Templates of fewer k-grams differ from one another by a word and must be covered whole.
SHORT = 12
#: A span may be so many times as long as its template.
STRETCH = 1.5
_words = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall

#: Phrases that count wherever they stand whole.
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}

#: Notices and license texts that are matched by coverage; (label, words).
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work worldwide"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution"),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("gpl-3", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
)


def words_of(text: str | None) -> list[str]:
    return _words(lower_ascii(text or ""))


def _word_hash(words: list[str]) -> np.ndarray:
    data = [w.encode("utf-8", "surrogatepass") for w in words]
    return np.array([(zlib.crc32(b) << 32 | zlib.crc32(b, 99)) for b in data], dtype=np.uint64)


_rows = WordRows(_word_hash)


def gram_hashes(words: list[str]) -> np.ndarray:
    """Rolling hashes of k words; element i is of the words from i."""
    if len(words) < K:
        return np.zeros(0, np.uint64)
    h = _rows.rows(words)
    out = h[: len(h) - K + 1]
    for k in range(1, K):
        out = mix(out, h[k : len(h) - K + 1 + k], k)
    return out


def template_rows() -> list[tuple[int, str, int, str, bool, int, int]]:
    """(hash, words, template, label, whole, position, number of k-grams) of every template position."""
    every = [(label, text, True) for label, text in PHRASES.items()] + [(label, text, False) for label, text in TEMPLATES]
    rows = []
    for i, (label, text, whole) in enumerate(every):
        words = text.split(" ")
        hashes = gram_hashes(words).view(np.int64)
        rows += [(int(h), " ".join(words[p : p + K]), i, label, whole, p, len(hashes)) for p, h in enumerate(hashes)]
    return rows


def votes(docs: DataFrame, templates: list) -> DataFrame:
    """(row, doc_id, n_words, place, hash, gram): one row per text with null place, and one per k-gram that may be a template's."""
    table = np.zeros(1 << TABLE_BITS, bool)
    table[np.array([r[0] for r in templates], np.int64).view(np.uint64) >> np.uint64(64 - TABLE_BITS)] = True
    sent = docs.sparkSession.sparkContext.broadcast(table)
    kinds = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("place", pa.int64()), ("hash", pa.int64()), ("gram", pa.string())])

    def run(batches: Batches) -> Batches:
        live = sent.value
        for batch in batches:
            rows: list[tuple] = []
            for row, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = words_of(text)
                rows.append((row, doc, len(words), None, None, None))
                h = gram_hashes(words)
                for p in np.nonzero(live[h >> np.uint64(64 - TABLE_BITS)])[0].tolist():
                    rows.append((row, None, None, p, int(h[p].astype(np.int64)), " ".join(words[p : p + K])))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], schema=kinds)

    # the row number tells apart rows that repeat an id; it depends on the input's files alone
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return numbered.mapInArrow(run, "row long, doc_id long, n_words long, place long, hash long, gram string")


def spans(found: DataFrame, templates: list) -> DataFrame:
    """(row, template, label, whole, grams, start, stop, coverage) of merged runs of diagonals; stop is the last word.

    coverage is the share of the template's k-grams that stand in the span with rising positions. Of a run longer than STRETCH
    templates only what stands about its strongest diagonal is the span, that much of it at most.
    """
    spark = found.sparkSession
    schema = "hash long, gram string, template int, label string, whole boolean, position int, grams int"
    positions = F.broadcast(spark.createDataFrame(templates, schema))  # fixed size: the templates above
    hits = found.where("place IS NOT NULL").join(positions, ["hash", "gram"]).withColumn("diagonal", F.col("place") - F.col("position"))
    lines = hits.groupBy("row", "template", "label", "whole", "grams", "diagonal").agg(
        F.collect_set("position").alias("seen")
    )
    side = Window.partitionBy("row", "template").orderBy("diagonal")
    # a phrase's diagonals are places of their own; others join the run before them if near
    fresh = F.col("whole") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(side) > GAP, F.lit(True))
    runs = lines.withColumn("run", F.sum(fresh.cast("long")).over(side))
    # a position on a diagonal is a place in the text
    at = F.transform("seen", lambda p: F.struct((F.col("diagonal") + p).alias("place"), p.alias("position")))
    merged = runs.withColumn("at", at).groupBy("row", "template", "label", "whole", "grams", "run").agg(
        F.array_sort(F.flatten(F.collect_list("at"))).alias("every"), F.max_by("diagonal", F.struct(F.size("seen"), -F.col("diagonal"))).alias("strongest")
    )
    longest, room = (F.col("grams") + K - 1) * STRETCH, (F.col("grams") + K - 1) * (STRETCH - 1) / 2
    fits = F.element_at("every", -1)["place"] - F.get("every", F.lit(0))["place"] + K <= longest
    near = F.filter("every", lambda x: x["place"].between(F.col("strongest") - room, F.col("strongest") + F.col("grams") - 1 + room))
    cut = merged.withColumn("at", F.when(fits, F.col("every")).otherwise(near))
    rising = F.filter("at", lambda x, i: (i == 0) | (x["position"] > F.get("at", i - 1)["position"]))
    covered = F.size(F.array_distinct(F.transform(rising, lambda x: x["position"]))) / F.col("grams")
    start, stop = F.get("at", F.lit(0))["place"], F.element_at("at", -1)["place"] + K - 1
    return cut.select("row", "template", "label", "whole", "grams", start.alias("start"), stop.alias("stop"), covered.alias("coverage"))


def scan(docs: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per input row.

    n_base counts the places of whole phrases; first_word and last_word are their smallest and largest
    start, null if there is none. labels adds those of notices covered by ``coverage`` or more.
    score is the best verified coverage of any template, phrases included. Null, empty and word-free texts have no
    labels (empty strings) and score 0. Rows that repeat an id stay apart; other columns are ignored.
    """
    templates = template_rows()
    found = cut_lineage(votes(docs, templates))  # read twice below; texts themselves are not kept
    hit = spans(found, templates)
    phrase = F.col("whole") & (F.col("coverage") >= 1.0)
    strong = phrase | (~F.col("whole") & (F.col("coverage") >= F.when(F.col("grams") < SHORT, 1.0).otherwise(coverage)))
    per_row = hit.groupBy("row").agg(
        F.count(F.when(phrase, 1)).alias("n_base"),
        F.min(F.when(phrase, F.col("start"))).alias("first_word"),
        F.max(F.when(phrase, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(phrase, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(strong, F.col("label")))), ",").alias("labels"),
        F.max("coverage").alias("score"),
    )
    texts = found.where("place IS NULL").select("row", "doc_id", "n_words")
    return texts.join(per_row, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )

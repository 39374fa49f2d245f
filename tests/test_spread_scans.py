"""Ordered scans over spread documents against reading one document after another; texts and pages that cost what they are long."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docquarry.functions.text import strip
from docquarry.operators import catalog, chunking
from docquarry.sources import formats, office
from docquarry.streaming import ingest


def plain_blocks(text):
    """markdown_blocks of one document, line by line."""
    import re

    out, path, fenced, kind_before = [], [], False, None
    for line in re.sub(r"\r\n?", "\n", text).split("\n"):
        fence = re.match(r"[ \t]*(```|~~~)", line)
        title = re.match(r"(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$", line)
        inside = fenced or bool(fence)
        kind = "code" if inside else "heading" if title else "blank" if not line.strip(" ") else "table" if re.match(r"[ \t]*\|.*\|[ \t]*$", line) else "text"
        opens = kind != kind_before or kind == "heading" or (kind == "code" and fence and not fenced)
        if fence:
            fenced = not fenced
        kind_before = kind
        if kind == "heading":
            path = [p for p in path if p[0] < len(title[1])] + [(len(title[1]), title[2])]
        if kind == "blank":
            continue
        if opens:
            out.append([kind, len(title[1]) if kind == "heading" else None, [title[2] if kind == "heading" else line], " > ".join(t for _, t in path)])
        else:
            out[-1][2].append(line)
    return [(i, k, level, "\n".join(lines), section) for i, (k, level, lines, section) in enumerate(out)]


@pytest.mark.parametrize("parts", ["1", "50"])
def test_markdown_blocks_equal_a_line_reader(spark, parts):
    rng = random.Random(5)
    lines = ["# A", "## B", "### C ##", "#### D", "text", "more text", "", "| a | b |", "|---|---|", "```", "~~~", "#no", "   ", "###### F"]
    docs = [(i, "\n".join(rng.choices(lines, k=rng.randrange(40)))) for i in range(40)] + [(100, "\n".join(rng.choices(lines, k=20_000))), (101, ""), (102, "one\r\ntwo\r\rthree")]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = formats.markdown_blocks(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    by_doc = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.block_no)):
        by_doc.setdefault(r.doc_id, []).append((r.block_no, r.kind, r.level, r.text, r.section))
    assert by_doc == {i: blocks for i, text in docs if (blocks := plain_blocks(text))}


@pytest.mark.parametrize("parts", ["1", "50"])
def test_procedures_equal_merging_one_document_after_another(spark, parts):
    rng = random.Random(8)
    texts = ["1. one", "2) two", "3. three", "step 4", "(5) five", "plain", "0. begin", "12. twelve"]
    rows = []
    for doc, n in [*((i, rng.randrange(12)) for i in range(30)), (99, 6_000)]:
        rows += [(doc, k, rng.choice(["list", "text", "text", "heading", "code", "image"]), rng.choice(texts)) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, block_no int, kind string, text string").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {(r.doc_id, r.block_no): r.run for r in chunking.procedures(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = {}
    for doc in {r[0] for r in rows}:
        own = [{"kind": k, "text": f"{t}\x00{n}", "atomic": False} for d, n, k, t in rows if d == doc]
        at = 0
        for merged in chunking._merge_steps(own):
            size = merged["text"].count("\x00")
            for k in range(size):
                want[doc, at + k] = at if merged["atomic"] else None
            at += size
    assert got == want


def test_blanks_and_open_tags_cost_their_length(spark):
    blanks = f"a{' ' * 1_000_000}b"
    df = spark.createDataFrame([(f"  {blanks}　\n",), (None,), ("",), ("\xa0 x\t",)], "t string").repartition(1)
    began = time.perf_counter()
    got = [r[0] for r in df.select(strip(F.col("t"))).collect()]
    assert got == [blanks, None, "", "x"] and time.perf_counter() - began < 5
    for page in ("<a " * 300_000, "<!--" * 250_000, '<a x="' * 150_000, "<script>" * 100_000, "<" * 500_000):
        began = time.perf_counter()
        parser = formats._Blocks()
        parser.feed(page)
        parser.flush()
        assert time.perf_counter() - began < 2


def test_pages_in_odd_forms():
    def blocks(page):
        parser = formats._Blocks()
        parser.feed(page)
        parser.flush()
        return [(kind, text) for kind, _, text, _ in parser.out]

    assert blocks("<p title='a > b'>x</p>1 < 2 &amp; 3 <p") == [("text", "x"), ("text", "1 < 2 & 3 <p")]
    assert blocks("<H1 class=a>T</H1 ><P>u<br/>v<script>if(a<b){'</p>'}</script>w") == [("heading", "T"), ("text", "u\nvw")]
    assert blocks("a<!-- b --><? c ?><!doctype d>e<!-- f") == [("text", "ae")]


def test_encodings_are_told_by_whole_files(spark, tmp_path):
    late = "name,city\n" + "".join(f"row{i},plain\n" for i in range(3_000))
    (tmp_path / "latin.csv").write_bytes(late.encode() + "end,Zürich\n".encode("latin-1"))
    (tmp_path / "utf8.csv").write_bytes((late + "end,Genève\n").encode())
    rows = office.read_delimited(spark, str(tmp_path)).where("name = 'end'").collect()
    assert sorted(r.city for r in rows) == ["Genève", "Zürich"]
    assert office.read_delimited(spark, str(tmp_path / "latin.csv")).where("name = 'end'").first().city == "Zürich"
    assert office.read_delimited(spark, str(tmp_path / "utf8.csv")).count() == 3_001


def test_names_with_commas_stay_whole(spark):
    docs = spark.createDataFrame([("w", "a,b.txt", "ready"), ("w", "c.txt", "ready"), ("w", "d", "pending"), ("v", "e", "failed")], "workspace_id string, filename string, status string")
    got = {r.workspace_id: r.names for r in catalog.corpus_state(docs).collect()}
    assert got == {"w": ["a,b.txt", "c.txt"], "v": []}


def test_an_older_row_in_a_later_batch_changes_nothing(spark, tmp_path):
    def run(rows):
        spark.createDataFrame(rows, "document_id long, content string, seq long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.chunk_stream(ingest.source(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination()
        return {r.document_id: r.content for r in ingest.latest_chunks(spark, str(tmp_path / "out")).collect()}

    assert run([(1, "new text", 5), (2, "other", 1)]) == {1: "new text", 2: "other"}
    assert run([(1, "old text", 3), (2, "newer", 2)]) == {1: "new text", 2: "newer"}
    assert run([(1, "newest", 6)])[1] == "newest"

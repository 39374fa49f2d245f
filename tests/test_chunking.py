"""Chunk rules, against a plain model and by invariants."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docquarry.functions.packing import group_ends, tail_units
from docquarry.functions.text import token_count
from docquarry.operators import chunking as C

ROW = "doc_id long, block_no int, kind string, text string, section string, table_header string, atomic boolean, slide int"


def rows(spark, blocks, doc=1):
    """blocks: (kind, text) or (kind, text, more)."""
    made = []
    for i, b in enumerate(blocks):
        more = b[2] if len(b) > 2 else {}
        made.append((doc, i, b[0], b[1], more.get("section"), more.get("table_header"), more.get("atomic", False), more.get("slide")))
    return spark.createDataFrame(made, ROW)


def chunks(spark, blocks, **more):
    out = C.assemble(C.gather(rows(spark, blocks)), **({"target": 60, "ceiling": 400} | more)).orderBy("ordinal").collect()
    assert [r.ordinal for r in out] == list(range(len(out)))
    return out


def filler(word, n):
    return " ".join([word] * n) + "."


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(1, 90))
def test_group_ends_are_greedy(costs, limit):
    ends, total, want = group_ends(np.array(costs, np.int64), limit), 0, []
    for i, c in enumerate(costs):
        if total and total + c > limit:
            want.append(i)
            total = 0
        total += c
    assert ends == want + [len(costs)] * bool(costs)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=30), st.integers(0, 90))
def test_tail_keeps_one_and_stops(costs, budget):
    n = total = 0
    for c in reversed(costs if budget else []):
        if n and total + c > budget:
            break
        n, total = n + 1, total + c
        if total >= budget:
            break
    assert tail_units(np.array(costs, np.int64), budget) == n


@pytest.mark.parametrize("text", ["", "a", "word " * 9, "x" * 99, "a b c d", "ünï 日本 \r\n z"])
def test_token_counts_agree(spark, text):
    assert spark.range(1).select(token_count(F.lit(text))).first()[0] == C.count(text)


def test_procedures_stay_whole(spark):
    steps = [("list", f"{i}. do thing {filler('really', 12)}") for i in range(1, 7)]
    out = chunks(spark, [("text", filler("intro", 5)), *steps, ("text", filler("end", 5))])
    holding = [r for r in out if "1. do" in r.content]
    assert len(holding) == 1 and all(f"{i}. do" in holding[0].content for i in range(1, 7))


def runs(spark, blocks):
    return [r.run for r in C.procedures(rows(spark, blocks)).orderBy("block_no").collect()]


def test_what_makes_a_procedure(spark):
    step = lambda n: ("list", f"{n}. x")
    assert runs(spark, [step(1), step(2), step(3)]) == [0, 0, 0]
    assert runs(spark, [step(1), step(1), step(1)]) == [None] * 3
    assert runs(spark, [step(2), step(3)]) == [None, None]
    assert runs(spark, [step(1), ("text", "note"), step(2)]) == [0, 0, 0]
    assert runs(spark, [step(1), ("text", "a"), ("text", "b"), step(2)]) == [None] * 4
    assert runs(spark, [step(1), ("heading", "h"), step(2)]) == [None] * 3
    assert runs(spark, [step(1), ("table", "| a |"), step(2), ("text", "tail")]) == [0, 0, 0, None]
    assert runs(spark, [("text", "Step 1 go"), ("text", "(2) on"), ("text", "3) done"), step(1), step(4)]) == [0, 0, 0, 3, 3]
    assert runs(spark, [step(0), step(5)]) == [0, 0]


def test_walk_and_windows_mark_the_same_runs(spark):
    rng = random.Random(3)
    docs = {d: [(rng.choice(["list", "text", "text", "heading", "image", "table"]), rng.choice(["{}. x", "note", "{}) y", "step {} z"]).format(rng.randint(0, 4))) for _ in range(rng.randint(1, 12))] for d in range(120)}
    every = rows(spark, docs[0], 0)
    for d in range(1, 120):
        every = every.unionByName(rows(spark, docs[d], d)) if d % 40 == 0 else every
    data = [(d, i, k, t, None, None, False, None) for d, bs in docs.items() for i, (k, t) in enumerate(bs)]
    marked = {}
    for r in C.procedures(spark.createDataFrame(data, ROW)).collect():
        marked.setdefault(r.doc_id, {})[r.block_no] = r.run
    for d, bs in docs.items():
        merged = C._merge_steps([{"kind": k, "text": t, "atomic": False} for k, t in bs])
        want = len(bs) - sum(x is not None for x in marked[d].values()) + len({x for x in marked[d].values() if x is not None})
        assert len(merged) == want


def test_tables_repeat_their_header(spark):
    header = "| a | b |\n| --- | --- |"
    body = "\n".join(f"| {i} | {filler('cell', 6)} |" for i in range(40))
    out = chunks(spark, [("text", "Before this."), ("table", f"{header}\n{body}", {"table_header": header}), ("text", "After.")])
    parts = [r for r in out if r.content.startswith(header)]
    assert len(parts) > 3 and all(r.token_count <= 60 for r in parts)
    assert [line for r in parts for line in r.content.split("\n")[2:]] == body.split("\n")
    small = chunks(spark, [("table", f"{header}\n| 1 | 2 |", {"table_header": header})])
    assert [r.content for r in small] == [f"{header}\n| 1 | 2 |"]


def test_over_long_procedure_says_that_it_goes_on(spark):
    text = "\n".join(f"{i}. {filler('step', 60)}" for i in range(1, 9))
    out = chunks(spark, [("list", text, {"atomic": True})], ceiling=200)
    assert len(out) > 2 and all(r.token_count <= 200 for r in out)
    assert not out[0].content.startswith(C.CONTINUED) and all(r.content.startswith(C.CONTINUED) for r in out[1:])


def test_slides_are_one_chunk_each(spark):
    blocks = [b for s in (1, 2, 3) for b in (("heading", f"T{s}", {"slide": s, "section": f"T{s}"}), ("text", "one word", {"slide": s}), ("slide_notes", f"note {s}", {"slide": s}))]
    out = chunks(spark, [*blocks, ("text", "  ", {"slide": 4})])
    assert [r.content for r in out] == [f"T{s}\n\none word\n\nnote {s}" for s in (1, 2, 3)]
    assert [r.section for r in out] == ["T1", "T2", "T3"]


def test_overlap_and_coverage(spark):
    sentences = [f"Sentence number {i} says {filler('word', i % 5 + 3)}" for i in range(40)]
    out = chunks(spark, [("text", " ".join(sentences))])
    assert len(out) > 3
    for a, b in zip(out, out[1:], strict=False):
        assert C._sentences(a.content)[-1] in b.content.split("\n\n")[0]
    joined = " ".join(r.content for r in out)
    assert all(s in joined for s in sentences)
    assert all(r.token_count <= 60 + 9 + 20 for r in out)


def test_one_giant_sentence_is_cut_by_words(spark):
    out = chunks(spark, [("text", filler("w", 900))])
    assert sum(r.content.count("w") for r in out) >= 900 and all(r.token_count <= 130 for r in out)


def test_no_blocks(spark):
    assert chunks(spark, [("text", " "), ("text", None)]) == []
    assert C.assemble(C.paragraphs(spark.createDataFrame([(1, None), (2, "")], "document_id long, content string"))).collect() == []
    two = C.assemble(C.paragraphs(spark.createDataFrame([(1, "One.\r\n\r\nTwo.\n \nThree.")], "document_id long, content string"))).collect()
    assert [r.content for r in two] == ["One.\n\nTwo.\n\nThree."]


def plain_chunks(text, target=500, overlap=75):
    """Chunks of a text without blank lines, sentence by sentence."""
    import re

    def packed(units, limit):
        """Units joined while they fit, a space counted with each."""
        out, size = [], 0
        for u in units:
            cost = C.count(u) + 1
            if out and size + cost <= limit:
                out[-1] += f" {u}"
                size += cost
            else:
                out.append(u)
                size = cost
        return out

    split = lambda t: [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", t) if s.strip()]
    text = text.strip()
    if not text:
        return []
    parts = [text]
    if C.count(text) > target:
        parts = packed([u for s in split(text) for u in (packed(s.split(), target) if C.count(s) > target else [s])], target)
    out, size = [parts[0]], C.count(parts[0])
    for part in parts[1:]:
        if size + C.count(part) <= target:
            out[-1] += f"\n\n{part}"
            size += C.count(part)
            continue
        kept, room = [], overlap
        for s in reversed([s for p in out[-1].split("\n\n") for s in split(p)]):
            if kept and C.count(s) > room or room <= 0:
                break
            kept.insert(0, s)
            room -= C.count(s)
        again = " ".join(kept)
        out.append(f"{again}\n\n{part}" if again else part)
        size = C.count(part) + C.count(again)
    return out


def test_given_documents_equal_plain_chunks(spark):
    from docquarry.plans.catalogue import QUERIES
    from docquarry.session import table

    sf = "/root/testdata/sf0.01"
    got = {}
    for r in QUERIES["chunks_prose"](spark, sf).collect():
        got.setdefault(r.doc_id, {})[r.ordinal] = r.content
    want = {r.doc_id: dict(enumerate(c)) for r in table(spark, sf, "documents").collect() if (c := plain_chunks(r.text))}
    assert got == want


def test_tokens_are_told_by_a_counter(spark):
    docs = C.paragraphs(spark.createDataFrame([(1, "One two. Three four. Five six seven. Eight.")], "document_id long, content string"))
    out = C.assemble(docs, target=4, ratio=0.5, counter=lambda t: len(t.split())).orderBy("ordinal").collect()
    assert [(r.content, r.token_count) for r in out] == [("One two. Three four.", 4), ("Three four.\n\nFive six seven. Eight.", 6)]


def test_large_tables_are_sliced(spark):
    from docquarry.sources import formats as S

    rows = spark.range(25).select(F.lit("g").alias("g"), F.col("id").alias("k"))
    got = sorted(S.markdown_table(rows, "g", "k", ["k"], most=10).collect(), key=lambda r: r.slice)
    assert [r.text.split("\n") for r in got] == [["| k |", "| --- |", *(f"| {i} |" for i in range(lo, min(25, lo + 10)))] for lo in (0, 10, 20)]

"""Chunking: sentence parts, table and procedure parts, and the assembly of blocks to chunks.

A document's blocks are an array of (kind, text, section, table_header, atomic,
slide, page) in its row. What can be a column expression is one; where a chunk of a document ends, which depends on what it
repeats of the last one, is found in the sizes of its pieces inside an Arrow task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.packing import chunk_ranges, group_ends, grouped, pack_ends, tail_count, tail_units
from docquarry.functions.text import CHARS_PER_TOKEN, TOKENS_PER_WORD, sentences, strip, token_count, words
from docquarry.operators.ranges import scan

# fixed values: default sizes, sentence boundary, step markers and the mark of a continued procedure
TARGET, OVERLAP_RATIO, CEILING = 500, 0.15, 8192
SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9])|\n{2,}")
STEP_MARKERS = (r"^\s*(\d{1,3})\s*[.)\]]\s+\S", r"(?i)^\s*step\s+(\d{1,3})\b", r"^\s*\(\s*(\d{1,3})\s*\)\s+\S")
CONTINUED = "(procedure continued)"
#: A line's begin before a step marker.
STEP_BEGIN = re.compile(r"(?m)^(?=[^\S\n]*(?:\d{1,3}[^\S\n]*[.)\]][^\S\n]+\S|(?i:step)[^\S\n]+\d{1,3}\b|\([^\S\n]*\d{1,3}[^\S\n]*\)[^\S\n]+\S))")
STEP_KINDS = ("list", "text", "code", "table")


def packed_sentences(docs: DataFrame, limit: int = TARGET, id_col: str = "document_id", text_col: str = "content") -> DataFrame:
    """(document_id, part_no, n_units, tokens): greedy groups of sentences, a joining space counted as one token."""
    cut = docs.select(id_col, sentences(F.col(text_col)).alias("units"))
    sized = cut.withColumn("costs", F.transform("units", lambda s: token_count(s) + 1))
    ended = sized.select(id_col, "costs", pack_ends(F.col("costs"), limit).alias("ends"))
    groups = ended.select(id_col, F.posexplode(grouped(F.col("costs"), F.col("ends"))).alias("part_no", "group"))
    return groups.select(id_col, "part_no", F.size("group").alias("n_units"), F.aggregate("group", F.lit(0), lambda a, x: a + x).alias("tokens"))


def long_sentences(docs: DataFrame, limit: int, id_col: str = "document_id", text_col: str = "content") -> DataFrame:
    """(document_id, sentence_no, n_words, n_parts) of the sentences over the limit, cut by words."""
    units = docs.select(id_col, F.posexplode(sentences(F.col(text_col))).alias("sentence_no", "sentence")).where(token_count(F.col("sentence")) > limit)
    cut = units.withColumn("words", words(F.col("sentence")))
    ends = pack_ends(F.transform("words", lambda w: token_count(w) + 1), limit)
    return cut.select(id_col, "sentence_no", F.size("words").alias("n_words"), F.size(ends).alias("n_parts"))


def tails(docs: DataFrame, budget: int = int(TARGET * OVERLAP_RATIO), id_col: str = "document_id", text_col: str = "content") -> DataFrame:
    """(document_id, n_kept, overlap): the last sentences that the next chunk would repeat."""
    cut = docs.select(id_col, sentences(F.col(text_col)).alias("units"))
    kept = cut.withColumn("n_kept", tail_count(F.transform("units", token_count), budget))
    return kept.select(id_col, "n_kept", F.array_join(F.slice("units", F.greatest(F.lit(1), F.size("units") - F.col("n_kept") + 1), F.col("n_kept")), " ").alias("overlap"))


def step_number(text):
    """Number a block's first line opens with as a step, as a column; null if none."""
    first = F.regexp_extract(text, r"^\s*([^\r\n]*)", 1)
    found = [F.regexp_extract(first, p, 1) for p in STEP_MARKERS]
    return F.coalesce(*[F.when(x != "", x.cast("int")) for x in found])


def procedures(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Blocks with ``run``: blocks of one ascending numbered procedure share it, null elsewhere.

    A step belongs to the run of the step before it if its number is larger and what lies between is at most one
    unnumbered block; a run starts at 0 or 1 and has two steps or more. Headings and images end runs. Runs are found by scans over
    the blocks' numbers in block order, whatever number of blocks a document has; numbers have three digits and rise, so a run is
    short. block_no tells a document's blocks apart.
    """
    can = F.col("kind").isin(*STEP_KINDS)
    slim = blocks.select(id_col, "block_no", F.when(can, step_number(F.col("text"))).alias("n"), can.alias("can"))
    b = scan(slim, [id_col], ["block_no"], lags={"prev": (F.col("n"), 1), "prev2": (F.col("n"), 2), "between": (F.col("can"), 1)}, leads={"next": F.col("n")})
    goes_on = F.col("n").isNotNull() & ((F.col("n") > F.col("prev")) | (F.col("prev").isNull() & F.col("between") & (F.col("n") > F.col("prev2"))))
    # an unnumbered block is inside if the step after it goes on from the one before it
    inside = F.col("n").isNull() & F.col("can") & (F.col("next") > F.col("prev"))
    starts = ~F.coalesce(goes_on, F.lit(False)) & ~F.coalesce(inside, F.lit(False))
    b = scan(b.select(id_col, "block_no", "n", starts.alias("starts")), [id_col], ["block_no"], sums={"number": F.col("starts").cast("int")})
    group = Window.partitionBy(id_col, "number")
    good = (F.count("n").over(group) >= 2) & (F.min("n").over(group) <= 1)
    runs = b.withColumn("run", F.when(good, F.min("block_no").over(group))).where("run IS NOT NULL")
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (id_col, "block_no")]
    return blocks.alias("b").join(runs.alias("r"), same, "left").select("b.*", "r.run")


def count(text: str) -> int:
    """token_count inside tasks."""
    return max(1, math.ceil(max(len(text) / CHARS_PER_TOKEN, len(text.split()) * TOKENS_PER_WORD))) if text else 0


def _step(text: str) -> int | None:
    """step_number inside tasks."""
    first = text.lstrip().split("\n", 1)[0]
    found = [m for m in (re.match(p, first) for p in STEP_MARKERS) if m]
    return int(found[0][1]) if found else None


def _sentences(text: str) -> list[str]:
    return [s.strip() for s in SENTENCE_END.split(text) if s.strip()]


def _steps(text: str) -> list[str]:
    return [s.rstrip() for s in STEP_BEGIN.split(text) if s.strip()]


#: How texts are cut: into units of a level, each joined again by its glue; a unit over the limit is cut by the next level.
WORD_LEVEL = (str.split, " ")
PROSE = ((_sentences, " "), WORD_LEVEL)
ROWS = ((str.splitlines, "\n"), WORD_LEVEL)
STEPS = ((_steps, "\n"), *PROSE)


@dataclass
class Piece:
    """A block, or a part of one too large to be left whole; alone ones are chunks of their own."""

    text: str
    alone: bool
    block: dict


@dataclass
class Cutter:
    """Cuts texts and documents by a token counter; limits are in its tokens."""

    count: Callable[[str], int] = count

    def cut(self, text: str, limit: int, levels: Sequence[tuple[Callable[[str], list[str]], str]]) -> list[str]:
        """The text in parts of at most ``limit`` tokens, a joining glue counted with each unit; a word over the limit stands alone."""
        (units_of, glue), *finer = levels
        units = []
        for unit in units_of(text):
            units += (self.cut(unit, limit, finer) if finer and self.count(unit) > limit else None) or [unit]
        ends = group_ends(np.array([self.count(u) + self.count(glue) for u in units], np.int64), limit)
        return [glue.join(units[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def prose(self, text: str, limit: int) -> list[str]:
        return self.cut(text, limit, PROSE) or [text]

    def framed(self, text: str, limit: int, levels: Sequence, first: str, later: str) -> list[str]:
        """Parts that leave room for the line which the later ones begin with."""
        parts = self.cut(text, max(1, limit - self.count(later)), levels)
        return [(later if i else first) + part for i, part in enumerate(parts)]

    def pieces(self, block: dict, target: int, ceiling: int) -> list[Piece]:
        text, header = block["text"], block["table_header"] if block["kind"] == "table" else None
        if self.count(text) <= (ceiling if block["atomic"] and not header else target):
            return [Piece(text, False, block)]
        if header:
            body = "\n".join(text.splitlines()[len(header.splitlines()) :])
            parts = self.framed(body, target, ROWS, f"{header}\n", f"{header}\n") or [text]
        elif block["atomic"]:
            parts = self.framed(text, ceiling, STEPS, "", f"{CONTINUED}\n") if len(_steps(text)) > 1 else self.prose(text, ceiling)
        else:
            parts = self.prose(text, target)
        return [Piece(part, block["atomic"] or header is not None, block) for part in parts if part.strip()]

    def contents(self, blocks: list[dict], target: int, overlap: int, ceiling: int) -> Iterator[tuple[str, dict]]:
        """(content, first block) of a document's chunks in order; texts are joined once a range is known."""
        pieces = [p for block in blocks for p in self.pieces(block, target, ceiling)]
        content = again = ""

        def repeat(lo: int, hi: int) -> int:
            """The last sentences of the chunk before, which the next one begins with."""
            nonlocal again
            units = _sentences(content)
            again = " ".join(units[len(units) - tail_units(np.array([self.count(u) for u in units], np.int64), overlap) :])
            return self.count(again)

        sizes, alone = np.array([self.count(p.text) for p in pieces], np.int64), np.array([p.alone for p in pieces], bool)
        for lo, hi in chunk_ranges(sizes, alone, target, repeat):
            content = "\n\n".join([*filter(None, [again]), *(p.text for p in pieces[lo:hi])]).strip()
            again = ""
            yield content, pieces[lo].block


def _slides(blocks: list[dict]) -> Iterator[tuple[str, dict]]:
    """(content, first block with a section) of each slide."""
    slides: dict[int, list[dict]] = {}
    for block in blocks:
        slides.setdefault(block["slide"] or 0, []).append(block)
    for own in slides.values():
        yield "\n\n".join(b["text"] for b in own).strip(), next((b for b in own if b["section"]), own[0])


KINDS = {"kind": "string", "text": "string", "section": "string", "table_header": "string", "atomic": "boolean", "slide": "int", "page": "int"}
FIELDS = tuple(KINDS)
BLOCKS = f"array<struct<{','.join(f'{k}:{v}' for k, v in KINDS.items())}>>"


def _merge_steps(blocks: list[dict]) -> list[dict]:
    """Each numbered procedure as one atomic list block; the same runs as ``procedures`` marks."""
    can = [b["kind"] in STEP_KINDS for b in blocks]
    n = [_step(b["text"]) if c else None for b, c in zip(blocks, can, strict=True)]
    at = lambda i: n[i] if 0 <= i < len(n) else None
    above = lambda x, y: x is not None and y is not None and x > y
    runs: list[list[int]] = []
    for i in range(len(blocks)):
        if n[i] is not None:
            on = above(n[i], at(i - 1)) or i > 1 and n[i - 1] is None and can[i - 1] and above(n[i], n[i - 2])
        else:
            on = can[i] and above(at(i + 1), at(i - 1))
        if on:
            runs[-1].append(i)
        else:
            runs.append([i])
    out = []
    for run in runs:
        steps = [n[i] for i in run if n[i] is not None]
        if len(steps) > 1 and steps[0] <= 1:
            out.append(blocks[run[0]] | {"kind": "list", "atomic": True, "text": "\n".join(blocks[i]["text"] for i in run)})
        else:
            out += [blocks[i] for i in run]
    return out


def gather(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Block rows to one row a document with its blocks in order, for block tables; parsers make such rows without a shuffle."""
    rows = F.array_sort(F.collect_list(F.struct("block_no", *(f for f in FIELDS if f in blocks.columns))))
    return blocks.groupBy(id_col).agg(rows.alias("blocks"))


def assemble(docs: DataFrame, id_col: str = "doc_id", target: int = TARGET, ratio: float = OVERLAP_RATIO, ceiling: int = CEILING, counter: Callable[[str], int] = count) -> DataFrame:
    """(doc_id, ordinal, section, content, token_count, page, slide) from rows (doc_id, blocks).

    Every document is cut where its row is; nothing is shuffled. Blank blocks are dropped; documents
    without blocks have no chunks; documents with slides get one chunk a slide. A chunk has the section, page and slide of its
    first block; the page of a slide is its number. Fields that the blocks lack count as null. ``counter`` tells the tokens of a text.
    """
    have = docs.schema["blocks"].dataType.elementType.names
    rows = docs.select(id_col, F.transform("blocks", lambda b: F.struct(*[(b[f] if f in have else F.lit(None)).cast(k).alias(f) for f, k in KINDS.items()])).alias("blocks"))
    kind = dict(rows.dtypes)[id_col]
    overlap, cutter = int(target * ratio), Cutter(counter)

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = [b for b in blocks or () if b["text"] and b["text"].strip()]
                made = _slides(held) if any(b["slide"] is not None for b in held) else cutter.contents(_merge_steps(held), target, overlap, ceiling)
                parts = [(p, b) for content, b in made for p in ([content] if counter(content) <= ceiling else cutter.prose(content, ceiling))]
                out += [(doc, i, b["section"], p, counter(p), b["slide"] if b["page"] is None else b["page"], b["slide"]) for i, (p, b) in enumerate(parts)]
            cols = list(zip(*out, strict=True)) or [()] * 7
            types = (batch.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[id_col, "ordinal", "section", "content", "token_count", "page", "slide"])

    return rows.mapInArrow(run, f"{id_col} {kind}, ordinal int, section string, content string, token_count int, page int, slide int")


def paragraphs(docs: DataFrame, id_col: str = "document_id", text_col: str = "content") -> DataFrame:
    """(doc_id, blocks) of plain texts: a paragraph ends at a blank line."""
    cut = F.filter(F.transform(F.split(F.coalesce(text_col, F.lit("")), r"(?U)\n\s*\n"), strip), lambda p: p != "")
    none = F.lit(None).cast("string")
    block = lambda p: F.struct(F.lit("text").alias("kind"), p.alias("text"), none.alias("section"), none.alias("table_header"), F.lit(False).alias("atomic"), F.lit(None).cast("int").alias("slide"))
    return docs.select(F.col(id_col).alias("doc_id"), F.transform(cut, block).alias("blocks"))

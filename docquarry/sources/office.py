"""Blocks of files by their type: a registry of parsers, the office and tabular formats, and delimited files as tables."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators.chunking import BLOCKS, FIELDS, KINDS, gather
from docquarry.sources import formats as S

# fixed values: name spaces of the formats, delimiters that are tried, most characters of a cell
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DELIMITERS = (",", ";", "\t", "|")
CELL_CHARS = 2000
SAMPLE_CHARS = 8192


def decode_text(content: Column) -> Column:
    """UTF-8 without its mark, or Latin-1 where the bytes are no UTF-8."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^﻿", "")


def _joined(node: ElementTree.Element, tag: str) -> str:
    return "".join(t.text or "" for t in node.iter(tag)).strip()


def _grid(rows: Iterator[list[str]]) -> tuple[str, str]:
    """A pipe table of rows with text, padded to the widest, and its header."""
    kept = [r for r in rows if any(r)]
    if not kept:
        return "", ""
    wide = max(map(len, kept))
    lines = [f"| {' | '.join(r + [''] * (wide - len(r)))} |" for r in kept]
    header = f"{lines[0]}\n| {' | '.join(['---'] * wide)} |"
    return "\n".join([header, *lines[1:]]), header


def _block(kind: str, text: str, section: str | None, header: str | None = None, slide: int | None = None) -> dict:
    return dict(zip(FIELDS, (kind, text, section, header, False, slide, None), strict=True))


def _docx(data: zipfile.ZipFile) -> Iterator[dict]:
    """Paragraphs and tables in body order; heading and title styles make the section path."""
    body = ElementTree.fromstring(data.read("word/document.xml")).find(f"{W}body")
    path: list[tuple[int, str]] = []
    for node in body if body is not None else ():
        section = " > ".join(t for _, t in path) or None
        if node.tag == f"{W}tbl":
            text, header = _grid([_joined(c, f"{W}t") for c in row.findall(f"{W}tc")] for row in node.findall(f"{W}tr"))
            if text:
                yield _block("table", text, section, header)
        elif node.tag == f"{W}p" and (text := _joined(node, f"{W}t")):
            found = node.find(f"{W}pPr/{W}pStyle")
            style = (found.get(f"{W}val") if found is not None else "").lower().replace(" ", "")
            if style == "title" or style.startswith("heading") and style[7:].isdigit():
                level = 1 if style == "title" else int(style[7:])
                path = [p for p in path if p[0] < level] + [(level, text)]
                yield _block("heading", text, " > ".join(t for _, t in path))
            else:
                yield _block("list" if "list" in style or "bullet" in style else "text", text, section)


def _pptx(data: zipfile.ZipFile) -> Iterator[dict]:
    """Blocks of each slide under its title, or its number where it has none; notes say that they are notes."""
    numbers = sorted(int(n[16:-4]) for n in data.namelist() if n.startswith("ppt/slides/slide") and n[16:-4].isdigit())
    for n in numbers:
        slide = ElementTree.fromstring(data.read(f"ppt/slides/slide{n}.xml"))
        shapes = [(s.find(f".//{P}ph"), [_joined(p, f"{A}t") for p in s.iter(f"{A}p")]) for s in slide.iter(f"{P}sp")]
        title = next((" ".join(filter(None, lines)) for ph, lines in shapes if ph is not None and ph.get("type", "") in ("title", "ctrTitle") and any(lines)), "")
        section = title or f"Slide {n}"
        if title:
            yield _block("heading", title, section, slide=n)
        for ph, lines in shapes:
            text = "\n".join(filter(None, lines))
            if text and not (title and ph is not None and ph.get("type", "") in ("title", "ctrTitle")):
                yield _block("text", text, section, slide=n)
        for table in slide.iter(f"{A}tbl"):
            text, header = _grid([_joined(c, f"{A}t") for c in row.findall(f"{A}tc")] for row in table.findall(f"{A}tr"))
            if text:
                yield _block("table", text, section, header, n)
        notes = f"ppt/notesSlides/notesSlide{n}.xml"
        if notes in data.namelist() and (text := _joined(ElementTree.fromstring(data.read(notes)), f"{A}t")):
            yield _block("slide_notes", f"Speaker notes: {text}", section, slide=n)


def _row_line(columns: list[str], cells: list[str]) -> str:
    """``serialise_row`` inside tasks."""
    named = [(c.strip(), v.strip()) for c, v in zip(columns, cells, strict=False)]
    return " | ".join(f"{c}: {v if len(v) <= CELL_CHARS else v[:CELL_CHARS] + '...'}" for c, v in named if c and v and v.lower() not in ("nan", "none"))


def _sheet(name: str | None, rows: Iterable[list[str]]) -> Iterator[dict]:
    """A heading for a named sheet, then each row with a cell as an atomic block; the first row names the columns."""
    rows = iter(rows)
    columns = next(rows, None)
    if columns is None:
        return
    if name:
        yield _block("heading", name, name)
    for cells in rows:
        if line := _row_line(columns, cells):
            yield _block("table", line, name) | {"atomic": True}


def _column(reference: str) -> int:
    """Number from 0 of a cell's column letters."""
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _cells(row: ElementTree.Element, shared: list[str]) -> list[str]:
    """Values of a row as text: shared, inline and formula strings, truth values, numbers as they are stored."""
    out: list[str] = []
    for c in row.findall(f"{X}c"):
        at = _column(c.get("r", "")) if c.get("r") else len(out)
        out += [""] * (at - len(out) + 1)
        kind, v = c.get("t"), c.findtext(f"{X}v") or ""
        out[at] = shared[int(v)] if kind == "s" and v else _joined(c, f"{X}t") if kind == "inlineStr" else {"1": "True", "0": "False"}.get(v, v) if kind == "b" else v
    return out


def _xlsx(data: zipfile.ZipFile) -> Iterator[dict]:
    """Sheets in the workbook's order; a sheet's rows are read one after another. Dates stay numbers."""
    shared: list[str] = []
    if "xl/sharedStrings.xml" in data.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{X}t")) for si in ElementTree.fromstring(data.read("xl/sharedStrings.xml")).findall(f"{X}si")]
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(data.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ElementTree.fromstring(data.read("xl/workbook.xml")).iter(f"{X}sheet"):
        path = links[sheet.get(f"{R}id")].lstrip("/")
        with data.open(path if path.startswith("xl/") else f"xl/{path}") as file:

            def rows(file=file) -> Iterator[list[str]]:
                for _, node in ElementTree.iterparse(file):
                    if node.tag == f"{X}row":
                        yield _cells(node, shared)
                        node.clear()

            yield from _sheet(sheet.get("name"), rows())


def _zipped(read: Callable[[zipfile.ZipFile], Iterator[dict]]) -> Callable[[bytes], list[dict]]:
    def parse(content: bytes) -> list[dict]:
        with zipfile.ZipFile(io.BytesIO(content)) as data:
            return list(read(data))

    return parse


def _text(content: bytes) -> str:
    """``decode_text`` inside tasks."""
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def _csv(content: bytes) -> list[dict]:
    text = _text(content)
    return list(_sheet(None, csv.reader(io.StringIO(text, newline=""), delimiter=sniff_delimiter(text[:SAMPLE_CHARS]))))


def _plain(content: bytes) -> list[dict]:
    return [_block("text", p.strip(), None) for p in re.split(r"\n\s*\n", _text(content)) if p.strip()]


def _html(content: bytes) -> list[dict]:
    parser = S._Blocks()
    parser.feed(_text(content))
    parser.flush()
    return [_block(kind, text, section or None) for kind, _, text, section in parser.out]


class Registry:
    """Which parser reads a type: exactly one each."""

    def __init__(self):
        self._parsers: dict[str, Callable[[bytes], list[dict]]] = {}

    def register(self, types: Iterable[str], parser: Callable[[bytes], list[dict]]) -> None:
        """Claims types for a parser (bytes to blocks); a claim of nothing, or of a type that has one, is an error."""
        claimed = list(types)
        if not claimed:
            raise ValueError("a parser must claim a type")
        if taken := [t for t in claimed if t in self._parsers]:
            raise ValueError(f"already claimed: {', '.join(taken)}")
        self._parsers |= dict.fromkeys(claimed, parser)

    def supports(self, mime: str) -> bool:
        return mime in self._parsers

    def get(self, mime: str) -> Callable[[bytes], list[dict]]:
        if mime not in self._parsers:
            raise LookupError(f"no parser for {mime}; there are {', '.join(sorted(self._parsers))}")
        return self._parsers[mime]


def default_registry() -> Registry:
    """Parsers of all types that are read in a task; markdown is read by ``parse_files`` as a table of lines."""
    made = Registry()
    for types, parser in (((S.DOCX,), _zipped(_docx)), ((S.PPTX,), _zipped(_pptx)), ((S.XLSX,), _zipped(_xlsx)), ((S.CSV,), _csv), ((S.TXT,), _plain), ((S.HTML,), _html)):
        made.register(types, parser)
    return made


def office_blocks(files: DataFrame, id_col: str = "path", registry: Registry | None = None) -> DataFrame:
    """(id, blocks, error) of rows (id, content, mime_type); a broken file has no blocks and says why, and stops no other."""
    parsers = registry or default_registry()
    block = pa.struct([(f, {"boolean": pa.bool_(), "int": pa.int32(), "string": pa.string()}[k]) for f, k in KINDS.items()])

    def run(batches):
        for batch in batches:
            blocks, errors = [], []
            for content, mime in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                made, error = [], None
                if not parsers.supports(mime):
                    error = "unsupported type"
                else:
                    try:
                        made = parsers.get(mime)(content or b"")
                    except (zipfile.BadZipFile, KeyError, IndexError, ValueError, csv.Error, ElementTree.ParseError) as broken:
                        error = f"{type(broken).__name__}: {broken}"[:200]
                blocks.append(made)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blocks, pa.list_(block)), pa.array(errors, pa.string())], names=[id_col, "blocks", "error"])

    kind = dict(files.dtypes)[id_col]
    return files.select(id_col, "content", "mime_type").mapInArrow(run, f"{id_col} {kind}, blocks {BLOCKS}, error string")


def parse_files(files: DataFrame, id_col: str = "path") -> DataFrame:
    """(id, blocks, error) of files of any supported type, each read by the one parser of its type."""
    md = files.where(F.col("mime_type") == S.MD).select(F.col(id_col).alias("doc_id"), decode_text(F.col("content")).alias("text"))
    none = {"table_header": F.when(F.col("kind") == "table", S.table_header(F.col("text"))), "atomic": F.lit(False), "slide": F.lit(None).cast("int"), "page": F.lit(None).cast("int")}
    blocks = gather(S.markdown_blocks(md).withColumns(none), "doc_id")
    read = md.select("doc_id").join(blocks, "doc_id", "left").select(F.col("doc_id").alias(id_col), F.transform(F.coalesce("blocks", F.array()), lambda b: F.struct(*[b[f].cast(k).alias(f) for f, k in KINDS.items()])).alias("blocks"), F.lit(None).cast("string").alias("error"))
    return office_blocks(files.where(F.coalesce(F.col("mime_type"), F.lit("")) != S.MD), id_col).unionByName(read)


def sheet_counts(parsed: DataFrame, id_col: str = "path") -> DataFrame:
    """(id, sheet, n): rows of each sheet of tabular files; a file without named sheets is sheet1."""
    rows = parsed.select(id_col, F.explode("blocks").alias("b")).where("b.atomic AND b.kind = 'table'")
    return rows.groupBy(id_col, F.coalesce("b.section", F.lit("sheet1")).alias("sheet")).agg(F.count("*").alias("n"))


def sniff_delimiter(sample: str) -> str:
    """The delimiter that cuts the sample's first rows, quotes heeded, into the same number of cells, most cells first; a comma if none does."""
    best, wide = ",", 1
    for delimiter in DELIMITERS:
        rows = list(islice(csv.reader(io.StringIO(sample, newline=""), delimiter=delimiter), 20))
        # the last row of a full sample may be cut off
        rows = [r for r in (rows[:-1] if len(sample) >= SAMPLE_CHARS and len(rows) > 1 else rows) if any(c.strip() for c in r)]
        widths = {len(r) for r in rows}
        if len(widths) == 1 and (found := widths.pop()) > wide:
            best, wide = delimiter, found
    return best


def read_delimited(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Delimited files with a header row. The delimiter is told from the first 8,192 characters, which is all text that the driver reads.

    A file is UTF-8 if all its bytes are, else ISO 8859-1; that takes a pass over the files in parallel. Quoted cells may hold line ends, which needs
    each file in one task; files without such cells can be split by ``multi_line=False``. Columns that a file lacks are null.
    """
    lines = spark.read.text(path)
    head = lines.limit(40).collect()
    sample = "\n".join(r.value for r in head)[:SAMPLE_CHARS].removeprefix("\ufeff")
    odd = {r[0] for r in lines.where(~F.is_valid_utf8("value")).select(F.input_file_name()).distinct().collect()}  # names of files
    read = lambda files, encoding: spark.read.csv(files, header=True, sep=sniff_delimiter(sample), multiLine=multi_line, encoding=encoding, escape='"')
    if not odd:
        return read(path, "UTF-8")
    rest = [f for f in lines.inputFiles() if f not in odd]
    latin = read(sorted(odd), "ISO-8859-1")
    return read(rest, "UTF-8").unionByName(latin, allowMissingColumns=True) if rest else latin


def row_blocks(rows: DataFrame, sheet: str | None = None) -> DataFrame:
    """Each row of a table as an atomic block of its own: (text, section)."""
    line = S.serialise_row({c: F.col(f"`{c}`") for c in rows.columns}, CELL_CHARS)
    return rows.select(line.alias("text"), F.lit(sheet).alias("section"), F.lit("table").alias("kind"), F.lit(True).alias("atomic")).where("text <> ''")

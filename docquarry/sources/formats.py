"""File formats: MIME detection, delimited rows, markdown and HTML blocks."""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.operators.ranges import row_numbers, scan

# fixed values: types, extensions and aliases
PDF, CSV, TXT, MD, HTML = "application/pdf", "text/csv", "text/plain", "text/markdown", "text/html"
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
PPTX = "application/vnd.openxmlformats-officedocument.presentationml.presentation"
XLSX = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
DOC, PPT, XLS = "application/msword", "application/vnd.ms-powerpoint", "application/vnd.ms-excel"
EXTENSIONS = {"pdf": PDF, "docx": DOCX, "pptx": PPTX, "xlsx": XLSX, "xlsm": XLSX, "doc": DOC, "ppt": PPT, "xls": XLS, "csv": CSV, "tsv": CSV, "txt": TXT, "md": MD, "markdown": MD, "html": HTML, "htm": HTML}
ALIASES = {"application/x-pdf": PDF, "text/x-markdown": MD, "application/csv": CSV, "text/comma-separated-values": CSV, "text/tab-separated-values": CSV, "application/vnd.ms-excel.sheet.macroenabled.12": XLSX, "application/xhtml+xml": HTML}
SUPPORTED = (PDF, DOCX, PPTX, XLSX, DOC, PPT, XLS, CSV, TXT, MD, HTML)


def declared_type(declared: Column) -> Column:
    """A declared type without parameters, aliases resolved; null if it isn't supported."""
    plain = F.lower(F.trim(F.split_part(F.coalesce(declared, F.lit("")), F.lit(";"), F.lit(1))))
    known = F.coalesce(*[F.when(plain == a, F.lit(t)) for a, t in ALIASES.items()], plain)
    return F.when(known.isin(*SUPPORTED), known)


def extension_type(filename: Column) -> Column:
    ext = F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), r"\.([^./\\]+)$", 1))
    return F.coalesce(*[F.when(ext == e, F.lit(t)) for e, t in EXTENSIONS.items()])


def zip_folders(content: Column) -> Column:
    """First-level folder names in the directory of a ZIP column, none where there is no readable one.

    The end record (PK 05 06, at least 22 bytes before the end) names the directory's size and place; each of its
    entries (PK 01 02) has 46 bytes before its name. Expressions over its bytes as hexadecimal digits; only ZIPs are read.
    """
    number = lambda digits, at, n: F.conv(F.concat(*[F.substring(digits, at + 2 * k, 2) for k in reversed(range(n))]), 16, 10).cast("long")
    # the end record may be followed by a comment of 65,535 bytes
    end = F.hex(F.substring(content, F.greatest(F.lit(1), F.octet_length(content) - 65_556), 65_557))
    record = F.regexp_extract(end, "^(?:..)*(504B0506.{36})", 1)
    directory = F.hex(F.substring(content, (number(record, F.lit(33), 4) + 1).cast("int"), number(record, F.lit(25), 4).cast("int")))
    entries = F.split(directory, "504B0102")
    name = lambda e: F.decode(F.unhex(F.substring(e, F.lit(85), (number(e, F.lit(49), 2) * 2).cast("int"))), "ISO-8859-1")
    folder = lambda e: F.regexp_extract(name(e), "^([^/]+)/", 1)
    found = F.array_distinct(F.transform(F.filter(entries, lambda e: F.length(e) > 84), folder))
    return F.when(F.hex(F.substring(content, 1, 4)).startswith("504B0304") & (record != ""), found).otherwise(F.array().cast("array<string>"))


def detect_mime(content: Column, filename: Column, declared: Column) -> Column:
    """The type of a binary column by its first bytes, with the declared type or extension as a hint; null is a reject.

    A ZIP's folder names are read from its directory, which stands at its end.
    """
    hint = F.coalesce(declared_type(declared), extension_type(filename))
    head = F.hex(F.substring(content, 1, 8192))
    opening = F.lower(F.regexp_replace(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), r"^\s+", ""))
    folders = zip_folders(content)
    holds = lambda name: F.array_contains(folders, name)
    zipped = F.when(holds("word"), DOCX).when(holds("ppt"), PPTX).when(holds("xl"), XLSX).otherwise(hint)
    return (
        F.when(head.startswith("25504446"), PDF)
        .when(head.startswith("504B0304"), zipped)
        .when(head.startswith("D0CF11E0A1B11AE1"), F.when(hint.isin(DOC, PPT, XLS), hint))
        .when(opening.startswith("<!doctype html") | opening.startswith("<html") | opening.startswith("<?xml-stylesheet"), HTML)
        .when(~head.rlike("^(?:..)*?00"), F.when(hint.isin(CSV, MD, TXT, HTML), hint).otherwise(TXT))
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder tree with content and detected type."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "content", detect_mime(F.col("content"), F.col("path"), F.lit(None).cast("string")).alias("mime_type"))


def serialise_row(columns: dict[str, Column], cap: int = 2000) -> Column:
    """name: value | name: value, without empty, nan and none cells; long cells are cut."""
    cells = []
    for name, value in columns.items():
        v = F.trim(value.cast("string"))
        v = F.when(F.length(v) > cap, F.concat(F.substring(v, 1, cap), F.lit("..."))).otherwise(v)
        usable = (v != "") & ~F.lower(v).isin("nan", "none") & F.lit(name.strip() != "")
        cells.append(F.when(usable, F.concat(F.lit(f"{name}: "), v)))
    return F.concat_ws(" | ", *cells)


def markdown_table(rows: DataFrame, group: str, order: str, columns: list[str], most: int = 5_000) -> DataFrame:
    """(group, slice, header, text): a group's rows as pipe tables of at most ``most`` rows each, all with the header.

    Rows are numbered over range partitions, so a group of any size spreads over tasks; ``order`` should tell rows apart.
    """
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    header = f"| {' | '.join(columns)} |\n| {' | '.join('---' for _ in columns)} |"
    numbered = row_numbers(rows.select(group, F.col(order).alias("__order"), line.alias("line")), (group,), ("__order",), "__n")
    sliced = numbered.withColumn("slice", F.floor((F.col("__n") - 1) / most).cast("long"))
    gathered = sliced.groupBy(group, "slice").agg(F.array_sort(F.collect_list(F.struct("__n", "line"))).alias("rows"))
    return gathered.select(group, "slice", F.lit(header).alias("header"), F.concat(F.lit(header + "\n"), F.array_join(F.col("rows.line"), "\n")).alias("text"))


def table_header(text: Column) -> Column:
    """First two non-blank lines if the second is a rule of | : - and spaces, else null."""
    found = F.regexp_extract(text, r"^\s*([^\n]*\S[^\n]*\n\s*[|:\- ]*[|:\-][|:\- ]*)(?:\n|$)", 1)
    return F.when(found != "", F.regexp_replace(found, r"\n\s*\n", "\n"))


def markdown_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, block_no, kind, level, text, section) of markdown texts, by scans over their lines, spread whatever a document's length.

    Blocks end at headings, fences, blank lines and where a pipe table begins or ends; section is the
    path of headings above. An unclosed fence runs to the end. Ids tell documents apart.
    """
    lines = docs.select(id_col, F.posexplode(F.split(F.regexp_replace(text_col, r"\r\n?", "\n"), "\n")).alias("n", "line"))
    title = F.regexp_extract("line", r"^(#{1,6})\s+(.+?)\s*#*\s*$", 2)
    plain = F.when(title != "", "heading").when(F.trim("line") == "", "blank").when(F.col("line").rlike(r"^\s*\|.*\|\s*$"), "table").otherwise("text")
    d = lines.withColumns({"fence": F.col("line").rlike(r"^\s*(```|~~~)").cast("int"), "plain": plain})
    # how many fences there are up to a line tells whether it is code, and what the line before it is
    d = scan(d, [id_col], ["n"], sums={"fences": F.col("fence")}, lags={"before": (F.struct("fence", "plain"), 1)})
    inside = lambda fences, fence: (fences % 2 == 1) | (fence == 1)
    kind = F.when(inside(F.col("fences"), F.col("fence")), "code").otherwise(F.col("plain"))
    above = F.when(inside(F.col("fences") - F.col("fence"), F.col("before.fence")), "code").otherwise(F.col("before.plain"))
    d = d.withColumns({"kind": kind, "above": F.when(F.col("before").isNotNull(), above)}).withColumn("title", F.when(F.col("kind") == "heading", title))
    d = d.withColumn("level", F.when(F.col("title").isNotNull(), F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))))
    opens = ((F.col("kind") == "code") & (F.col("fence") == 1) & (F.col("fences") % 2 == 1)) | (F.col("kind") == "heading") | ~F.col("kind").eqNullSafe(F.col("above"))
    marks = {f"h{k}": F.when(F.col("level") == k, F.struct("n", "title")) for k in range(1, 7)}
    d = d.withColumn("opens", (opens & (F.col("kind") != "blank")).cast("int")).drop("before", "above", "plain", "fence", "fences")
    d = scan(d, [id_col], ["n"], sums={"block": F.col("opens")}, lasts=marks)
    # the path: for each level the last heading of it that no higher one has ended since
    live = [F.when(F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(F.col(f"h{j}.n"), F.lit(-1)) for j in range(1, k)]) < F.col(f"h{k}.n"), F.col(f"h{k}.title")) for k in range(1, 7)]
    d = d.withColumn("section", F.concat_ws(" > ", *live))
    gathered = d.where("kind <> 'blank'").groupBy(id_col, "block", "kind").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("rows"), F.first("level").alias("level"), F.first("title").alias("title"), F.first("section").alias("section"))
    text = F.when(F.col("kind") == "heading", F.col("title")).otherwise(F.array_join(F.col("rows.line"), "\n"))
    return gathered.select(id_col, (F.col("block") - 1).cast("int").alias("block_no"), "kind", "level", text.alias("text"), "section")


_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_PART = re.compile(r"""[>]|=\s*(["'])""")


class _Blocks:
    """Blocks of one page: headings with their path, paragraphs, lists, tables as pipe rows.

    The page is read once from left to right. A tag ends at the first > outside quoted values; where quotes never close, at the
    first > there is. A < that begins no tag or whose tag never ends is text; comments, scripts and styles that never end run to
    the end of the page.
    """

    SKIP = ("script", "style", "noscript", "head", "svg", "template")
    ENDS = ("p", "div", "section", "article", "blockquote", "pre", "figcaption", "ul", "ol", "table")
    RAW = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in ("script", "style")}

    def __init__(self):
        self.out: list[tuple[str, int | None, str, str]] = []
        self.path: list[tuple[int, str]] = []
        self.kind, self.text, self.skip, self.cells = "text", [], 0, []

    def feed(self, html: str) -> None:
        at = done = 0
        last, quoted = html.rfind(">"), True
        while (at := html.find("<", at)) >= 0:
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                end = len(html) if end < 0 else end + 3
            elif html[at + 1 : at + 2] in ("!", "?"):
                end = html.find(">", at) + 1 if last > at else 0
            else:
                closes = html.startswith("/", at + 1)
                name = _TAG_NAME.match(html, at + 1 + closes)
                end = 0
                if name and last > at:
                    end = self._end(html, name.end()) if quoted else 0
                    if not end:
                        quoted, end = False, html.find(">", name.end()) + 1
            if not end:
                at += 1
                continue
            self.handle_data(unescape(html[done:at]))
            if html[at + 1] not in "!?":
                tag = name[0].lower()
                if closes:
                    self.handle_endtag(tag)
                else:
                    self.handle_starttag(tag)
                    if html[end - 2] == "/":
                        self.handle_endtag(tag)
                    elif tag in self.RAW:
                        close = self.RAW[tag].search(html, end)
                        at = done = close.start() if close else len(html)
                        continue
            at = done = end
        self.handle_data(unescape(html[done:]))

    @staticmethod
    def _end(html: str, at: int) -> int:
        """After the > that ends a tag, 0 if it never ends."""
        while found := _TAG_PART.search(html, at):
            if not found[1]:
                return found.end()
            at = html.find(found[1], found.end()) + 1
            if not at:
                return 0
        return 0

    def flush(self, level: int | None = None):
        lines = [" ".join(x.split()) for x in "".join(self.text).split("\n")]
        text, self.text = "\n".join(x for x in lines if x), []
        if not text:
            return
        if level:
            self.path = [p for p in self.path if p[0] < level] + [(level, text)]
        self.out.append(("heading" if level else self.kind, level, text, " > ".join(t for _, t in self.path)))

    def handle_starttag(self, tag):
        if tag in self.SKIP:
            self.skip += 1
        elif tag in ("ul", "ol", "table"):
            self.flush()
            self.kind = "table" if tag == "table" else "list"
        elif tag in self.ENDS or tag[:1] == "h" and tag[1:].isdigit():
            if self.kind == "text":
                self.flush()
        elif tag == "li":
            self.text.append("\n- ")
        elif tag == "br":
            self.text.append("\n")
        elif tag == "tr":
            self.text.append("\n| ")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag[:1] == "h" and tag[1:].isdigit() and len(tag) == 2:
            self.flush(int(tag[1]))
        elif tag in ("td", "th"):
            self.text.append(" | ")
        elif tag in ("ul", "ol", "table"):
            self.flush()
            self.kind = "text"
        elif tag in self.ENDS and self.kind == "text":
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.text.append(" ".join(data.split("\n")))


def html_documents(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, blocks): each page parsed where it is, its blocks (kind, level, text, section) in order."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("section", pa.string())]))

    def run(batches):
        for batch in batches:
            rows = []
            for html in batch.column(1).to_pylist():
                parser = _Blocks()
                parser.feed(html or "")
                parser.flush()
                rows.append([dict(zip(("kind", "level", "text", "section"), b, strict=True)) for b in parser.out])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=[id_col, "blocks"])

    return pages.select(F.col(id_col).cast("long").alias(id_col), html_col).mapInArrow(run, f"{id_col} long, blocks array<struct<kind:string,level:int,text:string,section:string>>")


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, block_no, kind, level, text, section), a row a block."""
    return html_documents(pages, id_col, html_col).select(id_col, F.posexplode("blocks").alias("block_no", "b")).select(id_col, "block_no", "b.*")

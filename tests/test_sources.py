"""Formats: MIME rules, markdown and HTML blocks, serialised rows."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docquarry.sources import formats as S


def zipped(name):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("[Content_Types].xml", "x")
        z.writestr(name, "x")
    return data.getvalue()


CASES = [
    (b"%PDF-1.7", "a.txt", None, S.PDF), (zipped("word/document.xml"), "a.bin", None, S.DOCX), (zipped("ppt/slides/1.xml"), "x", None, S.PPTX),
    (zipped("xl/workbook.xml"), "x", None, S.XLSX), (zipped("other.txt"), "a.zip", None, None), (bytes.fromhex("D0CF11E0A1B11AE1") + b"\0\0", "a.doc", None, S.DOC),
    (bytes.fromhex("D0CF11E0A1B11AE1"), "a.txt", None, None), (b"  \n<!DOCTYPE HTML><p>", "a.csv", None, S.HTML), (b"<html>", "", None, S.HTML),
    (b"a,b", "a.csv", None, S.CSV), (b"a\tb", "A.TSV", None, S.CSV), (b"# t", "a.MARKDOWN", None, S.MD), (b"x", "noext", None, S.TXT), (b"x", "a.pdf", None, S.TXT),
    (b"x", "a.txt", "Text/X-Markdown; charset=utf-8", S.MD), (b"x", "a.md", "application/zip", S.MD), (b"\x89PNG\r\n\x00\x01", "a.png", None, None), ("é".encode("latin-1"), "a.txt", None, S.TXT), (b"", "a.csv", None, S.CSV),
]


def test_mime(spark):
    df = spark.createDataFrame([(i, bytearray(c), n, d) for i, (c, n, d, _) in enumerate(CASES)], "i int, content binary, name string, declared string")
    got = [r.m for r in df.select("i", S.detect_mime(F.col("content"), F.col("name"), F.col("declared")).alias("m")).orderBy("i").collect()]
    assert got == [want for *_, want in CASES]


def test_zip_directories_are_read_at_their_end(spark):
    """A large first entry, names inside stored content and a comment don't mislead."""
    rows = []
    for i, (first, name, want) in enumerate([("docs/big.bin", "word/document.xml", S.DOCX), ("note.txt", "xl/workbook.xml", S.XLSX), ("word.txt", "readme", None)]):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_STORED) as z:
            z.writestr(first, b"ppt/ word/ xl/ " * 20_000)
            z.writestr(name, "x")
            z.comment = b"made by hand"
        rows.append((i, bytearray(data.getvalue()), want))
    rows.append((9, bytearray(b"PK\x03\x04 cut off word/"), None))
    df = spark.createDataFrame(rows, "i int, content binary, want string")
    assert all(r.want == r.got for r in df.select("want", S.detect_mime(F.col("content"), F.lit("a.zip"), F.lit(None).cast("string")).alias("got")).collect())


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# x")
    (tmp_path / "sub" / "b.html").write_text("<html></html>")
    assert sorted(r.mime_type for r in S.read_files(spark, str(tmp_path)).collect()) == [S.HTML, S.MD]


def test_serialised_rows(spark):
    df = spark.createDataFrame([(" a ", None, "NaN", 1.5, "y" * 2500), ("", "b", "none", None, "")], "p string, q string, r string, s double, t string")
    got = [r[0] for r in df.select(S.serialise_row({"p": F.col("p"), "q": F.col("q"), " ": F.col("q"), "r": F.col("r"), "s": F.col("s"), "t": F.col("t")})).collect()]
    assert got == ["p: a | s: 1.5 | t: " + "y" * 2000 + "...", "q: b"]


@pytest.mark.parametrize(("text", "header"), [("| a | b |\n| --- | :-: |\n| 1 | 2 |", "| a | b |\n| --- | :-: |"), ("| a |\n| 1 |", None), ("| a |", None), ("\n| a |\n|---|", "| a |\n|---|")])
def test_table_header(spark, text, header):
    assert spark.range(1).select(S.table_header(F.lit(text))).first()[0] == header


def test_markdown(spark):
    text = "# One #\nintro\n\n### Deep\n| a |\n|---|\n| 1 |\nafter\n## Two\r\n```py\n# no heading\n\n| x |\n```\nlast\n~~~\nopen"
    got = [(r.kind, r.text, r.section) for r in S.markdown_blocks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")).orderBy("doc_id", "block_no").collect()]
    assert got == [
        ("heading", "One", "One"), ("text", "intro", "One"), ("heading", "Deep", "One > Deep"), ("table", "| a |\n|---|\n| 1 |", "One > Deep"), ("text", "after", "One > Deep"),
        ("heading", "Two", "One > Two"), ("code", "```py\n# no heading\n\n| x |\n```", "One > Two"), ("text", "last", "One > Two"), ("code", "~~~\nopen", "One > Two"),
    ]


def test_html(spark):
    html = "<head><title>no</title></head><h1>A</h1><p>x<b>y</b>&nbsp;z<p>open<h3>C</h3><ul><li>1<li>2</ul><h2>B</h2><table><tr><th>k</th><td>v</td></tr></table><script>bad()</script><svg>bad</svg>tail"
    got = [(r.kind, r.level, r.text, r.section) for r in S.html_blocks(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("block_no").collect()]
    assert got == [
        ("heading", 1, "A", "A"), ("text", None, "xy z", "A"), ("text", None, "open", "A"), ("heading", 3, "C", "A > C"), ("list", None, "- 1\n- 2", "A > C"),
        ("heading", 2, "B", "A > B"), ("table", None, "| k | v |", "A > B"), ("text", None, "tail", "A > B"),
    ]

"""Office files, delimited files, replies and client work."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.operators import answers as A
from docquarry.operators import chunking as C
from docquarry.sources import formats as S
from docquarry.sources import office as O


def packed(files):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return bytearray(data.getvalue())


def para(text, style=None):
    mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{mark}<w:r><w:t>{text}</w:t></w:r></w:p>"


CELL = "<w:tc>{}</w:tc>"
DOCX = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>' + para("Top", "Title") + para("a") + para("Sub", "Heading2") + para("b", "ListBullet") + "<w:tbl><w:tr>" + CELL.format(para("k")) + CELL.format(para("v")) + "</w:tr><w:tr>" + CELL.format(para("1")) + "</w:tr></w:tbl>" + para("Next", "Heading1") + para("") + para("c") + "</w:body></w:document>"
NS = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def slide(*shapes):
    return f"<p:sld {NS}>" + "".join(f"<p:sp>{f'<p:nvSpPr><p:nvPr><p:ph type=\"{k}\"/></p:nvPr></p:nvSpPr>' if k else ''}<p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>" for k, t in shapes) + "</p:sld>"


def test_office_files(spark):
    pptx = packed({"ppt/slides/slide2.xml": slide((None, "no title")), "ppt/slides/slide1.xml": slide(("title", "T"), (None, "body")), "ppt/notesSlides/notesSlide1.xml": slide((None, "n"))})
    rows = [("a", packed({"word/document.xml": DOCX}), S.DOCX), ("b", pptx, S.PPTX), ("c", bytearray(b"junk"), S.DOCX), ("d", packed({"x": "y"}), S.DOCX), ("e", None, S.PDF)]
    out = O.office_blocks(spark.createDataFrame(rows, "path string, content binary, mime_type string"))
    got = {r.path: r for r in out.collect()}
    assert [(b.kind, b.text, b.section) for b in got["a"].blocks] == [("heading", "Top", "Top"), ("text", "a", "Top"), ("heading", "Sub", "Top > Sub"), ("list", "b", "Top > Sub"), ("table", "| k | v |\n| --- | --- |\n| 1 |  |", "Top > Sub"), ("heading", "Next", "Next"), ("text", "c", "Next")]
    assert [(b.kind, b.text, b.section, b.slide) for b in got["b"].blocks] == [("heading", "T", "T", 1), ("text", "body", "T", 1), ("slide_notes", "Speaker notes: n", "T", 1), ("text", "no title", "Slide 2", 2)]
    assert got["c"].error.startswith("BadZipFile") and got["d"].error.startswith("KeyError") and got["e"].error == "unsupported type"
    chunks = C.assemble(out.withColumnRenamed("path", "doc_id"))
    assert chunks.where("doc_id = 'b'").count() == 2


XML = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
BOOK = f'<workbook xmlns="{XML}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Prices" r:id="r2"/><sheet name="Empty" r:id="r1"/></sheets></workbook>'
RELS = '<Relationships><Relationship Id="r1" Target="worksheets/sheet2.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet1.xml"/></Relationships>'
SHEET = f'<worksheet xmlns="{XML}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>cost</t></is></c></row><row><c r="A2" t="str"><v>tea</v></c><c r="B2"><v>9</v></c><c r="C2"><v>1.5</v></c></row><row><c r="A3"><v></v></c></row><row><c r="A4" t="b"><v>1</v></c><c r="C4" t="s"><v>1</v></c></row></sheetData></worksheet>'


def test_every_type_has_one_parser(spark):
    xlsx = packed({"xl/workbook.xml": BOOK, "xl/_rels/workbook.xml.rels": RELS, "xl/worksheets/sheet1.xml": SHEET, "xl/worksheets/sheet2.xml": f'<worksheet xmlns="{XML}"/>', "xl/sharedStrings.xml": f'<sst xmlns="{XML}"><si><r><t>na</t></r><r><t>me</t></r></si><si><t>none</t></si></sst>'})
    rows = [
        ("x", xlsx, S.XLSX), ("c", bytearray("k;v\n1;\"two\nlines\"\n;\n".encode()), S.CSV), ("l", bytearray("k,v\né,2".encode("latin-1")), S.CSV), ("t", bytearray(b"one\n\n two \n"), S.TXT), ("h", bytearray(b"<h1>T</h1><p>x"), S.HTML),
        ("m", bytearray(b"# T\n\n| a |\n|---|\n| 1 |"), S.MD), ("e", bytearray(b""), S.MD), ("z", bytearray(b"%PDF"), S.PDF), ("n", None, None), ("b", packed({"xl/workbook.xml": BOOK}), S.XLSX),
    ]
    parsed = O.parse_files(spark.createDataFrame(rows, "path string, content binary, mime_type string"))
    got = {r.path: r for r in parsed.collect()}
    shown = {k: [(b.kind, b.text, b.section, b.atomic) for b in r.blocks] for k, r in got.items()}
    assert shown["x"] == [("heading", "Prices", "Prices", False), ("table", "name: tea | cost: 1.5", "Prices", True), ("table", "name: True", "Prices", True)]
    assert shown["c"] == [("table", "k: 1 | v: two\nlines", None, True)] and shown["l"] == [("table", "k: é | v: 2", None, True)]
    assert shown["t"] == [("text", "one", None, False), ("text", "two", None, False)] and shown["h"] == [("heading", "T", "T", False), ("text", "x", "T", False)]
    assert shown["m"] == [("heading", "T", "T", False), ("table", "| a |\n|---|\n| 1 |", "T", False)] and got["m"].blocks[1].table_header == "| a |\n|---|"
    assert shown["e"] == shown["z"] == shown["n"] == [] and got["e"].error is None and got["z"].error == got["n"].error == "unsupported type" and got["b"].error.startswith("KeyError")
    assert {(r.path, r.sheet): r.n for r in O.sheet_counts(parsed).collect()} == {("x", "Prices"): 2, ("c", "sheet1"): 1, ("l", "sheet1"): 1}
    assert C.assemble(parsed.withColumnRenamed("path", "doc_id")).count() >= 6


def test_a_type_is_claimed_once():
    registry = O.default_registry()
    assert registry.supports(S.XLSX) and not registry.supports(S.PDF)
    for types in ([], [S.PDF, S.CSV]):
        with pytest.raises(ValueError):
            registry.register(types, lambda content: [])
    registry.register([S.PDF], lambda content: [])
    assert registry.get(S.PDF)(b"") == []
    with pytest.raises(LookupError):
        registry.get(S.DOC)


def test_delimited_files_with_quoted_line_ends(spark, tmp_path):
    (tmp_path / "q.csv").write_bytes("name,note\nJosé,\"two\nlines, \"\"quoted\"\"\"\n".encode("latin-1"))
    rows = O.read_delimited(spark, str(tmp_path / "q.csv")).collect()
    assert [tuple(r) for r in rows] == [("José", 'two\nlines, "quoted"')]


@pytest.mark.parametrize(("text", "sep"), [("a,b\n1,2", ","), ("a;b\n1,5;2", ";"), ("a\tb\n1\t2", "\t"), ("a|b|c\n1|2|3", "|"), ("one\ntwo", ","), ("", ",")])
def test_delimiters(spark, tmp_path, text, sep):
    assert O.sniff_delimiter(text) == sep
    if "\n" in text and text != "one\ntwo":
        (tmp_path / "t.csv").write_text("﻿" + text)
        rows = O.read_delimited(spark, str(tmp_path / "t.csv"))
        assert rows.columns[0] == "a" and rows.count() == 1
        assert O.row_blocks(rows).first().text.startswith("a: 1")


def test_decoding(spark):
    rows = spark.createDataFrame([(bytearray("﻿é".encode()),), (bytearray("é".encode("latin-1")),), (bytearray(b""),)], "content binary")
    assert [r[0] for r in rows.select(O.decode_text(F.col("content"))).collect()] == ["é", "é", ""]


@pytest.mark.parametrize(("n", "text"), [(0, ""), (1, "f1"), (2, "f1 and f2"), (5, "f1, f2, f3, f4 and f5"), (7, "f1, f2, f3, f4, f5, and 2 more")])
def test_listing(spark, n, text):
    items = F.array(*[F.lit(f"f{i}") for i in range(1, n + 1)]).cast("array<string>")
    assert spark.range(1).select(A.listing(items, 5)).first()[0] == text


def test_tags(spark):
    rows = spark.createDataFrame([(1, "policy", ["a", "b"]), (2, "policy", []), (3, "runbook", ["a"]), (4, None, None)], "id long, kind string, topics array<string>").withColumn("tags", F.struct("kind", "topics"))
    ids = lambda w: sorted(r.id for r in rows.where(A.has_tags(F.col("tags"), w)).collect())
    assert ids({"kind": "policy"}) == [1, 2] and ids({"topics": ["a"]}) == [1, 3] and ids({"kind": "policy", "topics": ["b", "a"]}) == [1]
    assert ids({"topics": []}) == [1, 2, 3] and ids({}) == [1, 2, 3, 4]


def test_client_batches(spark):
    rows = spark.range(70).repartition(1).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("t"))
    made = A.embed_texts(rows, "id", "t", A.hashing_embedder(16), 16).collect()
    again = {r.id: r.embedding for r in A.embed_texts(rows.repartition(3), "id", "t", A.hashing_embedder(16), 16, batch=5).collect()}
    assert len(made) == 70 and all(again[r.id] == r.embedding for r in made)
    assert np.allclose([np.linalg.norm(r.embedding) for r in made], 1, atol=1e-5)
    with pytest.raises(Exception, match="width 8"):
        A.embed_texts(rows, "id", "t", A.hashing_embedder(16), 8).collect()

    def client(prompts):
        if "t30" in prompts:
            raise TimeoutError
        return [p.upper() for p in prompts]

    got = {r.id: r.reply for r in A.complete_texts(rows, "id", "t", client).collect()}
    assert got[0] == "T0" and got[69] == "T69" and sum(v is None for v in got.values()) == 25

"""WARC derivatives: metadata and plain-text conversion records of response records.

Each response gives one ``metadata`` and one ``conversion`` record. Both refer
to it by its record id, target and date, and keep its target, date and payload
digest, and both name the other as concurrent. A page is read once, in time linear in its length whatever
its markup, by a function over Arrow batches; ids, digests and headers are built-in functions. Nothing is shuffled.
"""

from __future__ import annotations

import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Crawl date of tables that have none.
CRAWL_DATE = "2024-01-01T00:00:00Z"
#: Elements whose content is no text, and elements that end a line.
HIDDEN = ("script", "style", "noscript", "template", "svg")
BREAKING = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
#: Named references that end with a semicolon, all of HTML's, without that; the space that doesn't break is a plain one in plain text.
NAMED = {name[:-1]: chars for name, chars in html5.items() if name.endswith(";")} | {"nbsp": " "}
#: What is no text: comments and hidden elements, whichever begins first; ``visible`` finds the same without a second look.
NO_TEXT = "(?is)<(?:!--.*?--|" + "|".join(rf"{name}\b[^>]*>.*?</{name}\s*" for name in HIDDEN) + ")>"

_I = re.IGNORECASE | re.ASCII
_hidden = re.compile("<(?:!--|(" + "|".join(HIDDEN) + r")\b)", _I)
_closers = {name: re.compile(rf"</{name}\s*>", _I) for name in (*HIDDEN, "title")}
_comment_end = re.compile("-->")
_tag = re.compile(r"[a-zA-Z/!?][^>]*>")
_break = re.compile(rf"/?(?:{BREAKING})\b", _I)
_anchor = re.compile(r"a\b[^>]*\bhref=", _I)
_title = re.compile(r"<title\b", _I)
#: An html tag's attributes, quoted values whole; a quote that isn't closed ends them.
HTML_TAG = r"""<html\b((?:[^>"']|"[^"]*"|'[^']*')*)"""
ATTRIBUTE = r"""[^\s=/"']+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"']+))?"""
LANG = r"^lang\s*=\s*"
_html, _attribute, _lang = re.compile(HTML_TAG[:-1] + "+)", _I), re.compile(ATTRIBUTE, re.ASCII), re.compile(LANG, _I)
_reference = re.compile(r"&(?:#([0-9]+)|#[xX]([0-9a-fA-F]+)|([a-zA-Z][a-zA-Z0-9]*));")
_space = re.compile(r"[ \t\n\x0b\f\r]+")
_long_space = re.compile(r"[ \t\n\x0b\f\r]{2,}|[\t\n\x0b\f\r]")


class _Ahead:
    """Where a pattern is found next, asked with rising places: each place of the text is searched once."""

    def __init__(self, pattern: re.Pattern, text: str):
        self.pattern, self.text, self.found, self.asked = pattern, text, None, -1

    def __call__(self, at: int) -> re.Match | None:
        if self.asked < 0 or self.found is not None and self.found.start() < at:
            self.found, self.asked = self.pattern.search(self.text, at), at
        return self.found


def visible(html: str) -> str:
    """The page without comments and hidden elements; one that is never closed stays."""
    out, kept, ends, gt = [], 0, {}, _Ahead(re.compile(">"), html)
    at = 0
    while found := _hidden.search(html, at):
        at, name = found.end(), found[1]
        closer = ends.setdefault(name and name.lower(), _Ahead(_closers[name.lower()] if name else _comment_end, html))
        opened = gt(found.end()) if name else found
        end = closer(opened.end()) if opened else None
        if end is not None:
            out.append(html[kept : found.start()])
            at = kept = end.end()
    return "".join([*out, html[kept:]])


def unescape(text: str) -> str:
    """Named, decimal and hexadecimal references, each decoded once; those of no character stay."""

    def decode(m: re.Match) -> str:
        if m[3]:
            return NAMED.get(m[3], m[0])
        digits = (m[1] or m[2]).lstrip("0")
        code = int(digits, 10 if m[1] else 16) if 0 < len(digits) < 9 else 0
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return _reference.sub(decode, text) if "&" in text else text


def title_of(html: str) -> str:
    """What the first title element holds, on one line."""
    opened = _title.search(html)
    start = html.find(">", opened.end()) + 1 if opened else 0
    end = _closers["title"].search(html, start) if start else None
    return unescape(_space.sub(" ", html[start : end.start()]).strip(" ")) if end else ""


def language_of(html: str) -> str:
    """What the attribute lang of the first html tag that has it says, in quotes of either kind or without."""
    for tag in _html.finditer(html):
        for attribute in _attribute.findall(tag[1]):
            if found := _lang.match(attribute):
                value = attribute[found.end() :]
                return value[1:-1] if value[0] in "\"'" else value
    return ""


def text_of(shown: str) -> tuple[str, int]:
    """Text of a page's visible part, a line a block with white space collapsed, and its number of anchors.

    A tag ends at the first > and holds no other <; a < that begins no tag is text.
    """
    first, *pieces = shown.split("<")
    out, links = [first], 0
    for p in pieces:
        if p[:1] in ("a", "A") and _anchor.match(p):
            links += 1
        tag = _tag.match(p)
        if tag is None:
            out.append("<" + p)
        else:
            if _break.match(p):
                out.append("\x01")
            out.append(p[tag.end() :])
    text = _long_space.sub(" ", unescape("".join(out)))
    return "\n".join(line for x in text.split("\x01") if (line := x.strip(" "))), links


def page_parts(payload: Column) -> Column:
    """(title, language, outlinks, text) of a page."""

    def read(pages: pd.Series) -> pd.DataFrame:
        rows = [(title_of(p), language_of(p), *text_of(visible(p))) for p in pages]
        return pd.DataFrame({"title": [r[0] for r in rows], "language": [r[1] for r in rows], "outlinks": [r[3] for r in rows], "text": [r[2] for r in rows]})

    return F.pandas_udf(read, "title string, language string, outlinks long, text string")(payload)


def record_id(kind: str, *of: Column) -> Column:
    """A urn:uuid made from what the record is of, so that a rerun names it the same."""
    h = F.md5(F.concat(F.lit(kind), *[F.concat(F.lit("\n"), F.coalesce(c.cast("string"), F.lit(""))) for c in of]))
    return F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def responses(pages: DataFrame, date: str = CRAWL_DATE) -> DataFrame:
    """(page_id, record_id, target_uri, warc_date, http_headers, payload, payload_digest) of (page_id, url, html).

    A null page is an empty payload. Rows are kept one by one. Record ids are made from page id, target and payload, so rows
    equal in all three are one record seen again and have one id; ``write_warc`` writes it once.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(CRLF))
    return pages.select(
        F.col("page_id"),
        record_id("response", F.col("page_id"), F.col("url"), payload).alias("record_id"),
        F.col("url").cast("string").alias("target_uri"),
        F.lit(date).alias("warc_date"),
        head.alias("http_headers"),
        payload.alias("payload"),
        F.concat(F.lit("sha256:"), F.sha2(payload, 256)).alias("payload_digest"),
    )


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows a response: its metadata and its conversion record.

    (page_id, record_type, record_id, refers_to, concurrent_to, target_uri, warc_date, content_type,
    source_headers, payload_digest, block_digest, content_length, block). Empty payloads give empty
    texts. A null target stays null, and null pages have records too. Outlinks are the anchors that aren't hidden.
    """
    payload, source = F.col("payload"), F.col("record_id")
    part = F.col("__page")
    fields = F.concat(F.lit("title: "), part["title"], F.lit(f"{CRLF}language: "), part["language"], F.lit(f"{CRLF}outlinks: "), part["outlinks"].cast("string"), F.lit(f"{CRLF}source-content-length: "), F.octet_length(payload).cast("string"), F.lit(CRLF))
    bare = records.withColumn("__page", page_parts(payload))
    made = bare.withColumns({"__meta": fields, "__text": part["text"], "__m": record_id("metadata", F.col("target_uri"), source), "__c": record_id("conversion", F.col("target_uri"), source)})
    row = lambda kind, me, other, mime, block: F.struct(F.lit(kind).alias("record_type"), F.col(me).alias("record_id"), F.col(other).alias("concurrent_to"), F.lit(mime).alias("content_type"), F.col(block).alias("block"))
    both = F.array(row("metadata", "__m", "__c", "application/warc-fields", "__meta"), row("conversion", "__c", "__m", "text/plain; charset=utf-8", "__text"))
    out = made.withColumn("__d", F.explode(both))
    block = F.col("__d.block")
    return out.select(
        "page_id", "__d.record_type", F.col("__d.record_id").alias("record_id"), source.alias("refers_to"), "__d.concurrent_to", "target_uri", "warc_date", "__d.content_type",
        F.col("http_headers").alias("source_headers"), "payload_digest", F.concat(F.lit("sha256:"), F.sha2(block, 256)).alias("block_digest"), F.octet_length(block).cast("long").alias("content_length"), block.alias("block"),
    )


def record_text(rows: DataFrame) -> DataFrame:
    """(record): WARC/1.1 header and block of each derivative, without the two line ends that close a record."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise(F.lit(""))
    head = [
        F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.col("record_type"), F.lit(CRLF)),
        line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")), line("WARC-Refers-To-Target-URI", F.col("target_uri")),
        line("WARC-Refers-To-Date", F.col("warc_date")), line("WARC-Concurrent-To", F.col("concurrent_to")), line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Date", F.col("warc_date")), line("WARC-Block-Digest", F.col("block_digest")), line("WARC-Source-Payload-Digest", F.col("payload_digest")),
        line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")), F.lit(CRLF),
    ]
    return rows.select(F.concat(*head, F.col("block")).alias("record"))


def write_warc(rows: DataFrame, path: str) -> None:
    """Gzipped WARC files, one for each partition; a record ends with two line ends, and no record id stands twice."""
    record_text(rows.dropDuplicates(["record_id"])).write.option("lineSep", CRLF * 2).option("compression", "gzip").mode("overwrite").text(path)

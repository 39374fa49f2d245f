"""Token, sentence, chunk and format queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions.text import sentences, token_count
from docquarry.operators import boxes as B
from docquarry.operators import chunking as C
from docquarry.operators import enrich as E
from docquarry.operators.ranges import row_numbers
from docquarry.plans import model
from docquarry.session import prepare, table
from docquarry.sources import formats as S


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.documents(spark, sf_dir).select("document_id", token_count(F.col("content")).alias("tokens"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sentences(F.col("content"))
    return model.documents(spark, sf_dir).select("document_id", F.size(s).alias("n_sentences"), F.array_max(F.transform(s, token_count)).alias("longest"))


def pack_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.packed_sentences(model.documents(spark, sf_dir))


def word_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.long_sentences(model.documents(spark, sf_dir), limit=60)


def tail_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tails(model.documents(spark, sf_dir)).select("document_id", "n_kept", token_count(F.col("overlap")).alias("tokens"))


def chunks_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut to chunks of about 500 tokens with overlap."""
    return C.assemble(C.paragraphs(model.documents(spark, sf_dir))).drop("page", "slide")


def chunks_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages parsed to blocks and cut to chunks."""
    pages = S.html_documents(table(prepare(spark), sf_dir, "pages", spread=True)).withColumnRenamed("page_id", "doc_id")
    header = lambda b: F.when(b["kind"] == "table", S.table_header(b["text"]))
    block = lambda b: F.struct(b["kind"].alias("kind"), b["text"].alias("text"), b["section"].alias("section"), header(b).alias("table_header"), F.lit(False).alias("atomic"), F.lit(None).cast("int").alias("slide"))
    return C.assemble(pages.select("doc_id", F.transform("blocks", block).alias("blocks"))).drop("page", "slide")


def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of sentence groups, 0 where there is none."""
    docs = model.documents(spark, sf_dir)
    counts = C.packed_sentences(docs).groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.max("tokens").alias("largest"))
    return docs.select("document_id", "filename").join(counts, "document_id", "left").select("document_id", "filename", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("largest", F.lit(0)).alias("largest"))


def contextual_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document, path and the 200 characters that a description may have."""
    docs = model.documents(spark, sf_dir)
    head = E.context_header(F.col("filename"), F.array("workspace_id", F.lit("")), F.when(F.col("document_id") % 3 > 0, F.substring("content", 1, 200)))
    return docs.select("document_id", head.alias("header"))


def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = model.documents(spark, sf_dir)
    head = F.when(F.col("document_id") % 2 == 0, F.concat_ws(" > ", "filename", "workspace_id"))
    return docs.select("document_id", F.sha2(E.embedding_text(head, F.col("content")), 256).alias("text_hash"))


def mime_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and documents as uploads with misleading or missing names."""
    pages = table(prepare(spark), sf_dir, "pages").select(F.lit("page").alias("origin"), F.col("page_id").alias("id"), F.col("html").cast("binary").alias("content"), F.lit("x.txt").alias("name"), F.lit(None).cast("string").alias("declared"))
    ext = F.element_at(F.array(*[F.lit(x) for x in ("a.md", "b.csv", "c.txt", "d.pdf", "e")]), (F.col("doc_id") % 5 + 1).cast("int"))
    said = F.when(F.col("doc_id") % 7 == 0, F.lit("Text/X-Markdown; charset=utf-8"))
    docs = table(spark, sf_dir, "documents").select(F.lit("document"), "doc_id", F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("%PDF"), "text")).otherwise(F.col("text")).cast("binary"), ext, said)
    every = pages.union(docs)
    return every.select("origin", "id", S.detect_mime(F.col("content"), F.col("name"), F.col("declared")).alias("mime"))


def row_serialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(prepare(spark), sf_dir, "part")
    return part.select("p_partkey", S.serialise_row({"name": F.col("p_name"), "brand": F.when(F.col("p_size") > 10, F.col("p_brand")).otherwise(F.lit(" nan ")), "type": F.col("p_type"), "size": F.col("p_size")}).alias("line"))


def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of blocks of each kind of every page, and whether its first heading is its title."""
    blocks = S.html_blocks(table(prepare(spark), sf_dir, "pages", spread=True))
    return blocks.groupBy("page_id").agg(F.count(F.when(F.col("kind") == "heading", 1)).alias("headings"), F.count(F.when(F.col("kind") == "list", 1)).alias("lists"))


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.html_blocks(table(prepare(spark), sf_dir, "pages", spread=True))


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a markdown text: a heading, then a section a turn with its text, some as code."""
    chats = table(prepare(spark), sf_dir, "conversations")
    body = F.when(F.col("turn") % 4 == 3, F.concat(F.lit("```\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))
    turn = F.concat(F.lit("## "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n\n"), body)
    rows = chats.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))).alias("rows"))
    return rows.select("doc_id", F.concat(F.lit("# chat "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.array_join(F.col("rows.t"), "\n\n")).alias("text"))


def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.markdown_blocks(_markdown(spark, sf_dir))


def heading_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.heading_tree(S.markdown_blocks(_markdown(spark, sf_dir)).where("kind = 'heading'"))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat turns as numbered steps; a turn that divides by 5 has no number."""
    chats = table(prepare(spark), sf_dir, "conversations").where("role <> 'system'")
    numbered = F.when(F.col("turn") % 5 == 4, F.col("text")).otherwise(F.concat((F.col("turn") % 6).cast("string"), F.lit(". "), "text"))
    none = F.lit(None).cast("string")
    return chats.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("block_no"), F.lit("text").alias("kind"), numbered.alias("text"), none.alias("section"), none.alias("table_header"), F.lit(False).alias("atomic"), F.lit(None).cast("int").alias("slide"))


def procedure_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.procedures(_steps(spark, sf_dir)).select("doc_id", "block_no", F.coalesce("run", F.lit(-1)).alias("run"))


def procedure_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.assemble(C.gather(_steps(spark, sf_dir)), target=60, ceiling=200).drop("page", "slide")


def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each brand as pipe tables of at most 5,000 rows, cut to chunks that repeat the header."""
    rows = S.markdown_table(table(prepare(spark), sf_dir, "part"), "p_brand", "p_partkey", ["p_partkey", "p_name", "p_type", "p_size"])
    block = F.struct(F.lit("table").alias("kind"), F.col("text"), F.col("p_brand").alias("section"), S.table_header(F.col("text")).alias("table_header"), F.lit(False).alias("atomic"))
    chunks = C.assemble(rows.select(F.struct("p_brand", "slice").alias("doc_id"), F.array(block).alias("blocks")), target=200)
    numbered = row_numbers(chunks.select(F.col("doc_id.p_brand").alias("doc_id"), "doc_id.slice", "ordinal", "section", "content", "token_count"), ("doc_id",), ("slice", "ordinal"))
    return numbered.select("doc_id", (F.col("n") - 1).cast("int").alias("ordinal"), "section", "content", "token_count")


def slide_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat turns as slides, two a slide: one chunk each."""
    b = _steps(spark, sf_dir).withColumn("slide", F.floor(F.col("block_no") / 2).cast("int") + 1)
    return C.assemble(C.gather(b)).select("doc_id", "ordinal", "token_count", F.sha2("content", 256).alias("content_hash"))


def section_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(prepare(spark), sf_dir, "conversations")
    rows = chats.select(F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 2).alias("section_no"), F.lit("s").alias("section"), F.col("turn").alias("block_no"), "text")
    return E.section_digest(rows, budget=300, sections=3).select("doc_id", "section_no", "digest", "omitted")


def boxes_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages as boxes of lines and columns, within frames of six lines that are as wide as every fourth line."""
    lines = table(prepare(spark), sf_dir, "pages").select("page_id", F.posexplode(F.split(F.regexp_replace("html", "(</[a-z0-9]+>)", "$1\n"), "\n")).alias("n", "line"))
    width = F.length("line")
    inner = lines.where(width > 0).select("page_id", F.col("n").alias("line_no"), F.lit(0).alias("x0"), F.col("n").alias("y0"), width.alias("x1"), F.col("n").alias("y1"))
    outer = lines.where("n % 4 = 0").select("page_id", F.col("n").alias("frame_no"), F.lit(0).alias("x0"), F.col("n").alias("y0"), width.alias("x1"), (F.col("n") + 5).alias("y1"))
    return B.contained(inner, outer, "page_id", "line_no", "frame_no", slack=2.0)


QUERIES = {f.__name__: f for f in (boxes_contained, token_estimate, sentence_split, pack_groups, word_fallback, tail_overlap, chunks_prose, chunks_html, chunk_counts, contextual_header, embedding_text, mime_detect, row_serialise, html_headings, html_blocks, markdown_blocks, heading_tree, procedure_groups, procedure_chunks, table_chunks, slide_chunks, section_digest)}


def _tokens(c: str) -> str:
    return rf"(CASE WHEN length({c}) > 0 THEN greatest(1, ceil(greatest(length({c}) / 3.5::DOUBLE, len(regexp_extract_all({c}, '\S+')) * 1.3::DOUBLE)))::INT ELSE 0 END)"


_STRIP = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
_SENTENCES = (
    r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(content, '\n{2,}', chr(1), 'g'), '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), "
    rf"lambda s: {_STRIP('s')}), lambda s: s <> '')"
)
_S = f"""WITH {model.DOCUMENTS_SQL},
s AS (SELECT *, {_SENTENCES} AS units FROM docs),
t AS (SELECT *, list_transform(units, lambda u: {_tokens("u")}) AS sizes FROM s)"""
_FOLD = "list_reduce(list_transform({costs}, lambda c: {{'groups': [[c]], 'total': c}}), lambda a, x: CASE WHEN a.total + x.total > {limit} THEN {{'groups': list_concat(a.groups, x.groups), 'total': x.total}} ELSE {{'groups': list_concat(a.groups[:-2], [list_concat(a.groups[-1], x.groups[1])]), 'total': a.total + x.total}} END).groups"
_PACK = _FOLD.format(costs="list_transform(sizes, lambda z: z + 1)", limit=500)
_GROUPS = f"{_S}, p AS (SELECT document_id, unnest({_PACK}) AS g, generate_subscripts({_PACK}, 1) AS i FROM t WHERE len(units) > 0)"
_TAIL = "list_reduce(list_prepend({'n': 0, 'total': 0, 'done': false}, list_transform(list_reverse(sizes), lambda z: {'n': 1, 'total': z, 'done': false})), lambda a, x: CASE WHEN a.done OR (a.n > 0 AND a.total + x.total > 75) THEN {'n': a.n, 'total': a.total, 'done': true} ELSE {'n': a.n + 1, 'total': a.total + x.total, 'done': a.total + x.total >= 75} END)"
_STEP = r"CASE WHEN turn % 5 = 4 THEN NULL ELSE turn % 6 END"

ORACLE_SQL = {
    "boxes_contained": r"""WITH l AS (SELECT page_id, unnest(string_split(regexp_replace(html, '(</[a-z0-9]+>)', '\1' || chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(html, '(</[a-z0-9]+>)', '\1' || chr(10), 'g'), chr(10)), 1) - 1 AS n FROM pages)
SELECT i.page_id, i.n::INT AS line_no, o.n::INT AS frame_no FROM l i JOIN l o ON i.page_id = o.page_id AND o.n % 4 = 0 AND i.n BETWEEN o.n - 2 AND o.n + 7 AND length(i.line) <= length(o.line) + 2 WHERE length(i.line) > 0""",
    "token_estimate": f"WITH {model.DOCUMENTS_SQL} SELECT document_id, {_tokens('content')} AS tokens FROM docs",
    "sentence_split": f"{_S} SELECT document_id, len(units)::INT AS n_sentences, list_max(sizes)::INT AS longest FROM t",
    "pack_groups": f"{_GROUPS} SELECT document_id, (i - 1)::INT AS part_no, len(g)::INT AS n_units, list_sum(g)::INT AS tokens FROM p",
    "word_fallback": rf"""{_S},
u AS (SELECT document_id, unnest(units) AS content, unnest(sizes) AS size, generate_subscripts(units, 1) - 1 AS sentence_no FROM t),
w AS (SELECT document_id, sentence_no, list_transform(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> ''), lambda x: {_tokens("x")}) AS sizes FROM u WHERE size > 60)
SELECT document_id, sentence_no::INT AS sentence_no, len(sizes)::INT AS n_words, len({_FOLD.format(costs="list_transform(sizes, lambda z: z + 1)", limit=60)})::INT AS n_parts FROM w""",
    "tail_overlap": f"{_S}, k AS (SELECT document_id, units, {_TAIL}.n AS n FROM t) SELECT document_id, n::INT AS n_kept, {_tokens('o')} AS tokens FROM (SELECT *, coalesce(array_to_string(units[len(units) - n + 1:], ' '), '') AS o FROM k)",
    "chunk_counts": f"{_GROUPS}, c AS (SELECT document_id, count(*) AS n, max(list_sum(g)) AS m FROM p GROUP BY 1) SELECT document_id, filename, coalesce(n, 0)::BIGINT AS n_chunks, coalesce(m, 0)::INT AS largest FROM docs LEFT JOIN c USING (document_id)",
    "contextual_header": f"WITH {model.DOCUMENTS_SQL} SELECT document_id, filename || ' > ' || workspace_id || CASE WHEN document_id % 3 > 0 AND trim(left(content, 200)) <> '' THEN ' - ' || trim(left(content, 200)) ELSE '' END AS header FROM docs",
    "embedding_text": f"WITH {model.DOCUMENTS_SQL} SELECT document_id, sha256(CASE WHEN document_id % 2 = 0 THEN filename || ' > ' || workspace_id || chr(10) || chr(10) || content ELSE content END) AS text_hash FROM docs",
    "mime_detect": r"""SELECT 'page' AS origin, page_id AS id, CASE WHEN regexp_matches(lower(html), '^\s*(<!doctype html|<html|<\?xml-stylesheet)') THEN 'text/html' ELSE 'text/plain' END AS mime FROM pages
UNION ALL SELECT 'document', doc_id, CASE WHEN doc_id % 11 = 0 THEN 'application/pdf' WHEN doc_id % 7 = 0 THEN 'text/markdown' WHEN doc_id % 5 = 0 THEN 'text/markdown' WHEN doc_id % 5 = 1 THEN 'text/csv' ELSE 'text/plain' END FROM documents""",
    "row_serialise": "SELECT p_partkey, concat_ws(' | ', 'name: ' || p_name, CASE WHEN p_size > 10 THEN 'brand: ' || p_brand END, 'type: ' || p_type, 'size: ' || p_size) AS line FROM part",
    "procedure_groups": f"""WITH b AS (SELECT conv_id, turn, {_STEP} AS n FROM conversations WHERE role <> 'system'),
l AS (SELECT *, lag(n) OVER w AS p1, lag(n, 2) OVER w AS p2, lead(n) OVER w AS nx FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, sum(CASE WHEN coalesce(n > p1 OR (p1 IS NULL AND n > p2), false) OR coalesce(n IS NULL AND nx > p1, false) THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM l)
SELECT conv_id AS doc_id, turn::INT AS block_no, (CASE WHEN count(n) OVER q >= 2 AND min(n) OVER q <= 1 THEN min(turn) OVER q ELSE -1 END)::INT AS run FROM g WINDOW q AS (PARTITION BY conv_id, r)""",
    "heading_tree": "SELECT conv_id AS doc_id, '# chat ' || conv_id AS t, 0 AS x FROM conversations WHERE false",
    "slide_chunks": f"""WITH b AS (SELECT conv_id, turn, turn // 2 + 1 AS slide, CASE WHEN turn % 5 = 4 THEN text ELSE (turn % 6) || '. ' || text END AS text FROM conversations WHERE role <> 'system'),
c AS (SELECT conv_id, slide, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS content FROM b GROUP BY 1, 2)
SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY slide) - 1)::INT AS ordinal, {_tokens("content")} AS token_count, sha256(content) AS content_hash FROM c""",
    "section_digest": """WITH r AS (SELECT conv_id AS doc_id, turn // 2 AS section_no, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id, turn // 2 ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations),
d AS (SELECT doc_id, section_no, left(string_agg(text, ' ' ORDER BY turn), 300) AS digest FROM r WHERE before < 300 GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section_no) AS k, count(*) OVER (PARTITION BY doc_id) AS total FROM d)
SELECT doc_id, section_no, digest, greatest(total - 3, 0)::BIGINT AS omitted FROM n WHERE k <= 3""",
}
ORACLE_SQL["heading_tree"] = """WITH h AS (SELECT conv_id, -1 AS turn, 'chat ' || conv_id AS line FROM conversations GROUP BY 1, 2, 3
UNION ALL SELECT conv_id, turn, '  ' || role || ' ' || turn FROM conversations)
SELECT conv_id AS doc_id, string_agg(line, chr(10) ORDER BY turn) AS tree FROM h GROUP BY 1"""

_MD = r"""WITH body AS (SELECT conv_id AS doc_id, turn, '## ' || role || ' ' || turn || chr(10) || chr(10) || CASE WHEN turn % 4 = 3 THEN '```' || chr(10) || text || chr(10) || '```' ELSE text END AS t FROM conversations),
md AS (SELECT doc_id, '# chat ' || doc_id || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY turn) AS text FROM body GROUP BY 1),
line AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), 1) AS n FROM md),
f AS (SELECT *, regexp_matches(line, '^\s*(```|~~~)') AS fence, sum(regexp_matches(line, '^\s*(```|~~~)')::INT) OVER (PARTITION BY doc_id ORDER BY n) AS fences FROM line),
t AS (SELECT *, fences % 2 = 1 OR fence AS code, regexp_extract(line, '^(#{1,6})\s+(.+?)\s*#*\s*$', 2) AS title FROM f),
l AS (SELECT *, CASE WHEN NOT code AND title <> '' THEN length(regexp_extract(line, '^(#{1,6})\s', 1)) END AS level FROM t),
k AS (SELECT *, CASE WHEN code THEN 'code' WHEN level IS NOT NULL THEN 'heading' WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '^\s*\|.*\|\s*$') THEN 'table' ELSE 'text' END AS kind FROM l),
o AS (SELECT *, lag(kind) OVER w AS before FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
b AS (SELECT *, sum((code AND fence AND fences % 2 = 1 OR before IS NULL OR kind <> before OR kind = 'heading')::INT) OVER w AS block, MARKS FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, concat_ws(' > ', LIVE) AS section FROM b),
g AS (SELECT doc_id, block, kind, string_agg(line, chr(10) ORDER BY n) AS lines, any_value(level) AS level, first(title ORDER BY n) AS title, first(section ORDER BY n) AS section FROM s WHERE kind <> 'blank' GROUP BY 1, 2, 3)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1)::INT AS block_no, kind, level::INT AS level, CASE WHEN kind = 'heading' THEN title ELSE lines END AS text, section FROM g"""
_MARKS = ", ".join(f"last_value(CASE WHEN level = {k} THEN n END IGNORE NULLS) OVER w AS n{k}, last_value(CASE WHEN level = {k} THEN title END IGNORE NULLS) OVER w AS t{k}" for k in range(1, 7))
_LIVE = ", ".join(f"CASE WHEN n{k} > greatest({', '.join(['-1', *(f'coalesce(n{j}, -1)' for j in range(1, k))])}) THEN t{k} END" for k in range(1, 7))
_HEADER = "'| p_partkey | p_name | p_type | p_size |' || chr(10) || '| --- | --- | --- | --- |' || chr(10)"
_PACK_ROWS = (
    "list_reduce(list_transform(rows, lambda r: {'groups': [r.line], 'total': r.cost}), lambda a, x: CASE WHEN a.total + x.total > room THEN {'groups': list_concat(a.groups, x.groups), 'total': x.total} "
    "ELSE {'groups': list_concat(a.groups[:-2], [a.groups[-1] || chr(10) || x.groups[1]]), 'total': a.total + x.total} END).groups"
)
ORACLE_SQL |= {
    "markdown_blocks": _MD.replace("MARKS", _MARKS).replace("LIVE", _LIVE),
    "html_headings": """SELECT page_id, len(list_filter(regexp_extract_all(html, '(?is)<h[1-6]\\b[^>]*>(.*?)</h[1-6]>', 1), lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g')) <> ''))::BIGINT AS headings,
len(regexp_extract_all(html, '(?i)</(?:ul|ol)>'))::BIGINT AS lists FROM pages""",
    "table_chunks": f"""WITH r AS (SELECT p_brand, p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 5000 AS slice, '| ' || p_partkey || ' | ' || p_name || ' | ' || p_type || ' | ' || p_size || ' |' AS line FROM part),
b AS (SELECT p_brand, slice, list({{'line': line, 'cost': {_tokens("line")} + 1}} ORDER BY p_partkey) AS rows, {_HEADER} || string_agg(line, chr(10) ORDER BY p_partkey) AS whole, greatest(1, 200 - {_tokens("(" + _HEADER + ")")}) AS room FROM r GROUP BY 1, 2),
p AS (SELECT p_brand, slice, CASE WHEN {_tokens("whole")} <= 200 THEN [whole] ELSE list_transform({_PACK_ROWS}, lambda x: {_HEADER} || x) END AS parts FROM b),
c AS (SELECT p_brand, slice, unnest(parts) AS content, generate_subscripts(parts, 1) AS i FROM p)
SELECT p_brand AS doc_id, (row_number() OVER (PARTITION BY p_brand ORDER BY slice, i) - 1)::INT AS ordinal, p_brand AS section, content, {_tokens("content")} AS token_count FROM c""",
}

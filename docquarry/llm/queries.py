"""The registered queries of this package, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import bpe, chat, decontaminate, exactdedup, langid, lexical, licenses, quality, sharding, simhash, toxicity, trie, warc
from docquarry.session import prepare, table


def op1_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(prepare(spark), sf_dir, "conversations"))


def op2_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(prepare(spark), sf_dir, "documents", spread=True), keep="digests")


def op3_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.toxicity(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "labels"))


def op4_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(prepare(spark), sf_dir, "documents", spread=True))


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(prepare(spark), sf_dir, "pages", spread=True)))


def op6_decontamination_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = decontaminate.contaminated(table(spark, sf_dir, "documents", spread=True), decontaminate.items_of(table(spark, sf_dir, "benchmark")))
    return found.withColumns({c: F.round(c, 6) for c in ("score", "question_overlap", "answer_overlap")})


def op7_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(prepare(spark), sf_dir, "documents", spread=True))


QUALITY_COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents", spread=True).select("doc_id", "text")
    return quality.apply_rules(docs).select(*QUALITY_COLUMNS)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(prepare(spark), sf_dir, "documents", spread=True))


def op10_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded_digest(table(prepare(spark), sf_dir, "documents", spread=True))


def op11_exact_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exactdedup.exact_duplicates(table(prepare(spark), sf_dir, "documents", spread=True), digest_all=True)
    return found.withColumnRenamed("digest", "text_sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt_paths(table(prepare(spark), sf_dir, "conversations")))


def op13_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return lexical.ranked_search(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_snapshots": op1_chat_snapshots,
    "op2_bpe_automaton": op2_bpe_automaton,
    "op3_toxicity_ftrl": op3_toxicity_ftrl,
    "op4_language_codes": op4_language_codes,
    "op5_warc_derivatives": op5_warc_derivatives,
    "op6_decontamination_wand": op6_decontamination_wand,
    "op7_license_diagonals": op7_license_diagonals,
    "op8_quality_rules": op8_quality_rules,
    "op10_histogram_shards": op10_histogram_shards,
    "op9_simhash": op9_simhash,
    "op11_exact_refinement": op11_exact_refinement,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_dual_tree_search": op13_dual_tree_search,
}

_WS = r"[\x20\x09-\x0D]"

OP8_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)),
twice AS (SELECT doc_id, w FROM win GROUP BY ALL HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS p FROM win JOIN twice USING (doc_id, w)),
rep AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY 1),
m AS (
  SELECT doc_id, len(words) AS n_words,
    coalesce(length(array_to_string(words, '')), 0) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, len(lines) AS n_lines,
    len(list_filter(words, lambda w: lower(w) IN ({", ".join(f"'{w}'" for w in quality.STOP_WORDS)}))) AS n_stop
  FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND n_words BETWEEN 20 AND 200000
    AND word_chars::DOUBLE / n_words BETWEEN 2.0 AND 15.0
    AND n_symbols::DOUBLE / word_chars <= 0.2
    AND n_stop::DOUBLE / n_words >= 0.02
    AND n_dup_lines::DOUBLE / n_lines <= 0.5
    AND n_words::DOUBLE / n_lines >= 1.5 AS kept
FROM b
"""

OP1_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, role, text,
    '<|im_start|>' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS shown,
    coalesce('=' || role, '-') || chr(1) || coalesce('=' || text, '-') || chr(2) AS mark,
    sha256(coalesce(sha256(role), '-') || coalesce(sha256(text), '-')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT conv_id, shown, row_number() OVER w AS pos, string_agg(mark, '') OVER w AS prefix
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, digest ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT conv_id, max(pos) AS n_turns, max_by(prefix, pos) AS whole FROM p GROUP BY 1),
one AS (SELECT whole, n_turns, min(conv_id) AS conv_id FROM c GROUP BY 1, 2),
inner_ AS (SELECT DISTINCT prefix FROM p JOIN c USING (conv_id) WHERE pos < n_turns)
SELECT conv_id, n_turns::BIGINT AS n_turns, ((pos - 1) // 256)::BIGINT AS part, string_agg(shown, '' ORDER BY pos) AS text
FROM one JOIN p USING (conv_id) WHERE whole NOT IN (SELECT prefix FROM inner_) GROUP BY 1, 2, 3
"""


def _sql_id(kind: str, *of: str) -> str:
    parts = "".join(f" || chr(10) || coalesce({c}::VARCHAR, '')" for c in of)
    h = f"md5('{kind}'{parts})"
    cuts = " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"('<urn:uuid:' || {cuts} || '>')"


_NAMED = "MAP {" + ", ".join(f"""'{name}': '{chars.replace("'", "''")}'""" for name, chars in warc.NAMED.items()) + "}"


def _sql_unescape(text: str) -> str:
    decimal, hexa, name = (f"regexp_extract(p, '{x}', 1)" for x in ("^#0*([0-9]{1,8});", "^#[xX]0*([0-9a-fA-F]{1,8});", "^([a-zA-Z][a-zA-Z0-9]*);"))
    code = f"coalesce(try_cast({decimal} AS BIGINT), try_cast('0x' || nullif({hexa}, '') AS BIGINT), 0)"
    number = f"WHEN starts_with(p, '#') THEN CASE WHEN {code} BETWEEN 1 AND 1114111 AND {code} NOT BETWEEN 55296 AND 57343 THEN chr({code}::INT) || regexp_replace(p, '^#[^;]*;', '') ELSE '&' || p END"
    named = f"WHEN named.refs[{name}] IS NOT NULL THEN named.refs[{name}] || regexp_replace(p, '^[^;]*;', '')"
    pieces = f"string_split({text}, '&')"
    return f"({pieces}[1] || coalesce(array_to_string(list_transform({pieces}[2:], lambda p: CASE {number} {named} ELSE '&' || p END), ''), ''))"


def _sql_text(html: str) -> str:
    text = rf"regexp_replace({html}, '(?i)</?(?:{warc.BREAKING})\b[^<>]*>', chr(1), 'g')"
    return f"regexp_replace({text}, '<[a-zA-Z/!?][^<>]*>', '', 'g')"


OP5_SQL = rf"""
WITH named AS (SELECT {_NAMED} AS refs),
r AS (
  SELECT page_id, url AS target_uri, coalesce(html, '') AS payload, {_sql_id("response", "page_id", "url", "html")} AS refers_to FROM pages),
shown AS (SELECT *, regexp_replace(payload, '{warc.NO_TEXT}', '', 'g') AS visible FROM r),
bare AS (SELECT *, {_sql_text("visible")} AS stripped, regexp_extract(payload, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1) AS raw_title FROM shown),
t AS (
  SELECT *, {_sql_unescape("stripped")} AS plain, {_sql_unescape("trim(regexp_replace(raw_title, '[\\s\\x0B]+', ' ', 'g'))")} AS title,
    {_sql_id("metadata", "target_uri", "refers_to")} AS m, {_sql_id("conversion", "target_uri", "refers_to")} AS c
  FROM bare, named),
b AS (
  SELECT *, coalesce(array_to_string(list_filter(list_transform(string_split(regexp_replace(plain, '[ \t\n\x0B\f\r]{{2,}}|[\t\n\x0B\f\r]', ' ', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> ''), chr(10)), '') AS conversion,
    'title: ' || title || chr(13) || chr(10) || 'language: ' || coalesce(regexp_replace(regexp_replace(flatten(list_transform(regexp_extract_all(payload, '(?i){warc.HTML_TAG.replace("'", "''")}', 1), lambda t: list_filter(regexp_extract_all(t, '{warc.ATTRIBUTE.replace("'", "''")}'), lambda a: regexp_matches(a, '(?i){warc.LANG}'))))[1], '(?i){warc.LANG}', ''), '^["'']|["'']$', '', 'g'), '') || chr(13) || chr(10)
      || 'outlinks: ' || len(regexp_extract_all(visible, '(?i)<a\b[^<>]*\bhref=')) || chr(13) || chr(10) || 'source-content-length: ' || strlen(payload) || chr(13) || chr(10) AS metadata
  FROM t),
d AS (
  SELECT *, 'metadata' AS record_type, m AS record_id, c AS concurrent_to, 'application/warc-fields' AS content_type, metadata AS block FROM b
  UNION ALL SELECT *, 'conversion', c, m, 'text/plain; charset=utf-8', conversion FROM b)
SELECT page_id, record_type, record_id, refers_to, concurrent_to, target_uri, '{warc.CRAWL_DATE}' AS warc_date, content_type,
  'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(payload) || chr(13) || chr(10) AS source_headers,
  'sha256:' || sha256(payload) AS payload_digest, 'sha256:' || sha256(block) AS block_digest, strlen(block)::BIGINT AS content_length, block
FROM d
"""

_TEMPLATES = ", ".join(f"({i}, '{label}', {whole}, '{text}')" for i, (label, text, whole) in enumerate([(k, v, "true") for k, v in licenses.PHRASES.items()] + [(k, v, "false") for k, v in licenses.TEMPLATES]))

OP7_SQL = rf"""
WITH t AS (SELECT i AS template, label, whole, string_split(words, ' ') AS w FROM (VALUES {_TEMPLATES}) AS v(i, label, whole, words)),
tg AS (
  SELECT template, label, whole, len(w) - 2 AS grams, p - 1 AS position, array_to_string(w[p:p + 2], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - 1)) AS p FROM t)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, p - 1 AS place, array_to_string(w[p:p + 2], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - 1)) AS p FROM d)),
lines AS (
  SELECT doc_id, template, label, whole, grams, place - position AS diagonal, list(DISTINCT position) AS seen, min(place) AS start
  FROM g JOIN tg USING (gram) GROUP BY ALL),
fresh AS (SELECT *, whole OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {licenses.GAP}, true) AS f FROM lines),
runs AS (SELECT *, sum(f::INT) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM fresh),
z AS (
  SELECT doc_id, template, label, whole, grams, run, arg_max(diagonal, {{'n': len(seen), 'd': -diagonal}}) AS best, list_sort(flatten(list(list_transform(seen, lambda p: {{'place': diagonal + p, 'pos': p}})))) AS every
  FROM runs GROUP BY doc_id, template, label, whole, grams, run),
cut AS (
  SELECT * EXCLUDE (every), (grams + 2) * ({licenses.STRETCH} - 1) / 2 AS room, CASE WHEN every[-1].place - every[1].place + 3 <= (grams + 2) * {licenses.STRETCH} THEN every
    ELSE list_filter(every, lambda x: x.place BETWEEN best - (grams + 2) * ({licenses.STRETCH} - 1) / 2 AND best + grams - 1 + (grams + 2) * ({licenses.STRETCH} - 1) / 2) END AS spots FROM z),
m AS (
  SELECT *, spots[1].place AS start, len(list_distinct(list_transform(list_filter(spots, lambda x, i: i = 1 OR x.pos > spots[i - 1].pos), lambda x: x.pos)))::DOUBLE / grams AS coverage FROM cut),
k AS (SELECT *, whole AND coverage >= 1 AS phrase, NOT whole AND coverage >= CASE WHEN grams < {licenses.SHORT} THEN 1.0 ELSE {licenses.COVERAGE} END AS notice FROM m),
r AS (
  SELECT doc_id, count(*) FILTER (phrase) AS n_base, min(start) FILTER (phrase) AS first_word, max(start) FILTER (phrase) AS last_word,
    coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (phrase)), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (phrase OR notice)), ','), '') AS labels, max(coverage) AS score
  FROM k GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN r USING (doc_id)
"""

_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"

OP6_SQL = rf"""
WITH s AS (
  SELECT item_id, text, list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: len({_WORDS.format("x")}) > 0) AS parts, {_WORDS.format("text")} AS w
  FROM benchmark WHERE item_id IS NOT NULL),
i AS (
  SELECT item_id, w, CASE WHEN len(parts) > 1 THEN {_WORDS.format("array_to_string(parts[:-2], ' ')")} ELSE w[:len(w) - len(w) // 3] END AS question,
    CASE WHEN len(parts) > 1 THEN {_WORDS.format("parts[-1]")} ELSE w[len(w) - len(w) // 3 + 1:] END AS answer
  FROM s WHERE len(w) > 0),
n AS (SELECT count(*) AS items, avg(len(w)) AS mean_len FROM i),
st AS (SELECT item_id, greatest({decontaminate.LEAST_STRIDE}, pow(2, ceil(log2(len(w)))))::BIGINT AS stride, (3 * len(w) + 1) // 2 AS span, w AS own FROM i),
tf AS (SELECT item_id, len(w) AS size, term, count(*) AS f FROM (SELECT item_id, w, unnest(w) AS term FROM i) GROUP BY item_id, w, term),
df AS (SELECT term, count(*) AS n FROM tf GROUP BY 1),
raw AS (
  SELECT item_id, term, ln(1 + (items - df.n + 0.5) / (df.n + 0.5)) * f * {decontaminate.K1 + 1} / (f + {decontaminate.K1} * (1 - {decontaminate.B} + {decontaminate.B} * size / mean_len)) AS x
  FROM tf JOIN df USING (term), n),
impact AS (SELECT item_id, stride, term, x / sum(x) OVER (PARTITION BY item_id) AS x FROM raw JOIN st USING (item_id)),
d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, stride, start, w[start + 1:start + 2 * stride] AS w FROM (SELECT doc_id, w, stride, unnest(range(0, len(w), stride // 2)) AS start FROM d, (SELECT DISTINCT stride FROM st))),
bag AS (SELECT DISTINCT doc_id, stride, start, unnest(w) AS term FROM p),
hit AS (SELECT doc_id, stride, start, item_id, sum(x) AS score FROM bag JOIN impact USING (stride, term) GROUP BY ALL HAVING sum(x) >= {decontaminate.THRESHOLD} - 1e-9),
pos AS (SELECT doc_id, stride, start, item_id, score, span, own, w, unnest(range(0, len(w))) AS o FROM hit JOIN p USING (doc_id, stride, start) JOIN st USING (item_id, stride)),
win AS (SELECT doc_id, stride, start, item_id, score, o, unnest(w[o + 1:o + span]) AS term FROM pos WHERE list_contains(own, w[o + 1])),
held AS (SELECT doc_id, stride, start, item_id, score, o, term, count(*) AS f FROM win GROUP BY ALL),
side AS (
  SELECT item_id, kind, term, count(*) AS f FROM (
    SELECT item_id, 'q' AS kind, unnest(question) AS term FROM i UNION ALL SELECT item_id, 'a', unnest(answer) FROM i) GROUP BY ALL),
total AS (SELECT item_id, coalesce(sum(f) FILTER (kind = 'q'), 0) AS nq, coalesce(sum(f) FILTER (kind = 'a'), 0) AS na FROM side GROUP BY 1),
got AS (
  SELECT doc_id, stride, start, item_id, score, o, coalesce(sum(least(side.f, held.f)) FILTER (kind = 'q'), 0) AS q, coalesce(sum(least(side.f, held.f)) FILTER (kind = 'a'), 0) AS a
  FROM held JOIN side USING (item_id, term) GROUP BY ALL),
ok AS (SELECT doc_id, item_id, score, start + o AS place, q + a AS n, CASE WHEN nq > 0 THEN q::DOUBLE / nq ELSE 1 END AS q, CASE WHEN na > 0 THEN a::DOUBLE / na ELSE 1 END AS a FROM got JOIN total USING (item_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, place, round(score, 6) DESC) AS k FROM ok WHERE q >= {decontaminate.OVERLAP} AND a >= {decontaminate.OVERLAP})
SELECT doc_id, item_id, round(score, 6) AS score, round(q, 6) AS question_overlap, round(a, 6) AS answer_overlap, place AS first_word FROM best WHERE k = 1
"""

OP11_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, count(*) AS group_size, max(points) AS most FROM d GROUP BY 1),
k AS (SELECT text_sha256, min(doc_id) AS keep_id FROM d JOIN g USING (text_sha256) WHERE points = most GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256) JOIN k USING (text_sha256)
"""

# crc32 of the decimal id: a byte is folded in, then eight bits are shifted out
_BITS = "flatten(list_transform(range(1, len(conv_id::VARCHAR) + 1), lambda i: [ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
_CRC32 = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_BITS}), lambda s, b: CASE WHEN b >= 0 THEN xor(s, b) WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END), 4294967295)"

OP12_SQL = f"""
WITH t AS (
  SELECT conv_id, sha256(sha256(coalesce(role, '')) || sha256(coalesce(text, ''))) AS mark, length(coalesce(text, '')) AS points,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(sha256(coalesce(role, '')) || sha256(coalesce(text, '')))) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 100 AS family, {_CRC32} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT ids.conv_id, 0 AS part, n, mark, points FROM ids JOIN t ON t.conv_id = family WHERE n <= h
  UNION ALL SELECT conv_id, 1, n, mark, points FROM t JOIN ids USING (conv_id) WHERE n > h
  UNION ALL SELECT conv_id, -1, 0, '', 0 FROM ids),
p AS (
  SELECT conv_id, points, row_number() OVER w - 1 AS depth, string_agg(mark, '') OVER w AS prefix, lead(n) OVER (PARTITION BY conv_id ORDER BY part, n) IS NULL AS last
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
v AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(points) AS own,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
k AS (SELECT left(prefix, 64 * (depth - 1)) AS prefix, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY 1),
f AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN k USING (prefix)),
up AS (SELECT left(prefix, 64 * d) AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM f) GROUP BY 1)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM f JOIN up USING (prefix) LEFT JOIN v u ON f.depth > 0 AND u.prefix = left(f.prefix, 64 * (f.depth - 1))
"""

_TERMS13 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS13} AS w FROM documents),
b AS (SELECT item_id, unnest(list_distinct({_TERMS13})) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)),
s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
c AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM b) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
x AS (
  SELECT doc_id, term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS part
  FROM c JOIN f USING (term), s),
r AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM b JOIN x USING (term) GROUP BY 1, 2 HAVING sum(part) > 0),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r)
SELECT * FROM k WHERE rank <= {lexical.TOP}
"""

ORACLE_SQL: dict[str, str] = {
    "op1_chat_snapshots": OP1_SQL,
    "op5_warc_derivatives": OP5_SQL,
    "op6_decontamination_wand": OP6_SQL,
    "op7_license_diagonals": OP7_SQL,
    "op8_quality_rules": OP8_SQL,
    "op11_exact_refinement": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_dual_tree_search": OP13_SQL,
}

import glob
import gzip
import random

import time

import pytest
from pyspark.sql import functions as F

from docquarry.llm import chat, warc
from tests.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string, part int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, 9) for r in rows], SCHEMA)


def test_snapshots_collapse(spark):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", "bye"), ("assistant", None)]
    rows = [(10 + n, i, *talk[i]) for n in range(1, 5) for i in range(n)]
    rows += [(50, i, *t) for i, t in enumerate(talk)]  # equal to 14
    rows += [(60, 0, "user", "hi"), (60, 1, "assistant", "other")]
    rows += [(70, 0, None, None), (70, 0, None, None), (None, 0, "user", "lost"), (71, None, "user", "x"), (72, 0, "user", "")]
    got = {r.conv_id: r for r in chat.format_chats(turns(spark, rows)).collect()}
    assert sorted(got) == [14, 60, 70, 71, 72]
    assert got[14].n_turns == 4 and got[14].text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nbye<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert got[70].n_turns == 1 and got[70].text.startswith("<|im_start|>user\n<|im_end|>")
    assert chat.format_chats(turns(spark, [])).collect() == []


def by_hand(rows):
    """The same by plain Python over (conv_id, turn, role, text)."""
    import hashlib

    sha = lambda x: "-" if x is None else hashlib.sha256(x.encode()).hexdigest()
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", hashlib.sha256((sha(r[1]) + sha(r[2])).encode()).digest())
    chats = {}
    for conv, *turn in rows:
        if conv is not None:
            chats.setdefault(conv, set()).add(tuple(turn))
    lists = {c: [t[1:] for t in sorted(v, key=order)] for c, v in chats.items()}
    out = {}
    for c, own in lists.items():
        longer = any(len(o) > len(own) and o[: len(own)] == own for o in lists.values())
        equal = any(d < c and o == own for d, o in lists.items())
        if not longer and not equal:
            out[c] = (len(own), "".join(f"<|im_start|>{'user' if r is None else r}\n{t or ''}<|im_end|>\n" for r, t in own))
    return out


@pytest.mark.parametrize("long_rows, max_ids", [(1024, 1000), (3, 1000), (3, 0)])
def test_against_plain_python(spark, long_rows, max_ids):
    rng = random.Random(3)
    rows = []
    for conv in range(60):
        n, seed = rng.randrange(1, 9), rng.randrange(4)
        rows += [(conv, t if rng.random() < 0.95 else rng.choice([None, 0, 1]), ("user", "assistant", None)[(t + seed) % 3], f"{seed} {t}" if t < 4 or rng.random() < 0.7 else None) for t in range(n)]
    rows += [(77, 0, "user", "again")] * 40 + [(78, 0, "user", "b"), (78, 0, "user", "a"), (79, 0, "user", "a"), (80, 0, "user", "b"), (None, 1, "user", "x")]
    parts = {}
    for r in chat.format_chats(turns(spark, rows), turns_per_part=3, long_rows=long_rows, max_long_ids=max_ids).collect():
        assert (r.conv_id, r.part) not in parts
        parts[r.conv_id, r.part] = r
    got = {c: (parts[c, 0].n_turns, "".join(parts[c, p].text for p in range((parts[c, 0].n_turns + 2) // 3))) for c, _ in parts}
    assert got == by_hand(rows) and len(parts) == sum((n + 2) // 3 for n, _ in got.values())


def test_texts_are_exchanged_once(spark):
    """No exchange of turns before the one that rendering needs carries texts."""
    import re

    from docquarry.session import table

    chats = table(spark, SF, "conversations")
    plan = chat._plain(chats).groupBy("conv_id", "turn", "role", chat._mark().alias("mark")).agg(F.count("*").alias("n"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange.*text#", text)
    made = chat.format_chats(chats)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in made.splitlines() if "Join" in x]
    assert any("LeftAnti" in x for x in joins)


def test_one_long_conversation_over_many_partitions(spark):
    long = spark.range(4000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    snapshot = long.where("turn < 3000").withColumn("conv_id", F.lit(2).cast("long"))
    other = long.where("turn < 3000").withColumn("conv_id", F.lit(0).cast("long")).withColumn("text", F.when(F.col("turn") == 2999, "x").otherwise(F.col("text")))
    got = chat.format_chats(long.union(snapshot).union(other), turns_per_part=500).collect()
    assert {r.conv_id for r in got} == {0, 1}
    whole = "".join(r.text for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.part))
    assert whole == "".join(f"<|im_start|>user\nt{i}<|im_end|>\n" for i in range(4000))
    assert max(r.part for r in got) == 7


def test_prefix_hashes_do_not_depend_on_partitions(spark):
    rows = [(c, t, "user", f"{c % 3} {t}") for c in range(9) for t in range(c + 1)]
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = {(r.conv_id, r.pos): r.prefix for r in chat.prefixes(turns(spark, rows)).collect()}
        if n == "1":
            want = got
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want and got[6, 1] == got[3, 1] != got[4, 1]


PAGES = [
    (1, "http://a.example/", "<html lang=\"en\"><head><title> T &amp; x </title><style>p{}</style></head><body><!-- no --><script>var t='</p>';</script><p>One&nbsp;two</p>three<br>four &#65;&#233; &amp;lt; <a href='/x'>link</a></body></html>"),
    (2, None, None), (3, "http://b.example/", ""), (1, "http://a.example/", "<p>again"), (None, "u", "no markup &#xyz; &#99999999; 1 < 2"),
]


def test_records_are_linked(spark):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, block string")
    source = {(r.page_id, r.payload): r for r in warc.responses(df).collect()}
    rows = warc.derivatives(warc.responses(df)).collect()
    assert len(rows) == 10
    for r in rows:
        origin = next(s for s in source.values() if s.record_id == r.refers_to)
        assert (r.target_uri, r.warc_date, r.payload_digest, r.source_headers) == (origin.target_uri, origin.warc_date, origin.payload_digest, origin.http_headers)
        pair = next(x for x in rows if x.record_id == r.concurrent_to)
        assert pair.concurrent_to == r.record_id and pair.refers_to == r.refers_to and pair.record_type != r.record_type
        assert r.content_length == len(r.block.encode())
    text = {(r.page_id, r.refers_to): r.block for r in rows if r.record_type == "conversion"}
    assert "T & x\nOne two\nthree\nfour Aé &lt; link" in text.values() and "no markup &#xyz; &#99999999; 1 < 2" in text.values() and list(text.values()).count("") == 2
    meta = next(r.block for r in rows if r.record_type == "metadata" and "T & x" in r.block)
    assert "language: en\r\n" in meta and "outlinks: 1\r\n" in meta


def test_files_are_records(spark, tmp_path):
    df = spark.createDataFrame(PAGES[:1], "page_id long, url string, html string")
    warc.write_warc(warc.derivatives(warc.responses(df)), str(tmp_path / "w"))
    data = b"".join(gzip.open(f).read() for f in glob.glob(str(tmp_path / "w" / "*.gz")))
    heads = data.split(b"WARC/1.1\r\n")[1:]
    assert len(heads) == 2
    for h in heads:
        head, body = h.split(b"\r\n\r\n", 1)
        n = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n"))[b"Content-Length"])
        assert body[n:] == b"\r\n\r\n"


@pytest.mark.parametrize("page", ["<script>" * 125_000, "<!--" * 250_000, "<script " * 125_000 + "</script>", "<title>" * 140_000, "<html " * 160_000, "<html lang='" * 80_000, "<a href " * 120_000, "&#" * 500_000, "<" * 1_000_000], ids=lambda p: p[:12])
def test_hostile_pages_take_linear_time(page):
    import time

    began = time.process_time()
    warc.title_of(page), warc.language_of(page), warc.text_of(warc.visible(page))
    assert time.process_time() - began < 2


def test_hidden_parts_equal_the_pattern():
    """One pass finds what the pattern finds, unclosed and nested openers included."""
    import re

    rng = random.Random(6)
    bits = ["<script>", "</script>", "<SCRIPT x>", "</script >", "<style>", "</style>", "<!--", "-->", "<svg", ">", "</svg>", "text", "<p>", "<", "<scripty>", "<script-x>"]
    for _ in range(3000):
        page = "".join(rng.choices(bits, k=rng.randrange(14)))
        assert warc.visible(page) == re.sub(warc.NO_TEXT, "", page, flags=re.ASCII), page


@pytest.mark.parametrize(("text", "want"), [("&#x27;&#X1f642;&#000065;", "'🙂A"), ("&eacute;&rsquo;&NewLine;", "é’\n"), ("&amp;lt; &nosuch; &#xD800; &#0; &#x110000; & &;", "&lt; &nosuch; &#xD800; &#0; &#x110000; & &;")])
def test_references(text, want):
    assert warc.unescape(text) == want


def test_language_in_either_quotes():
    assert [warc.language_of(p) for p in ("<html lang='de'>", '<HTML class="a" LANG="fr">', "<html><html lang='x'>", "<html lang=en>", "<p lang='de'>")] == ["de", "fr", "x", "en", ""]


def test_no_pages(spark):
    assert warc.derivatives(warc.responses(spark.createDataFrame([], "page_id long, url string, html string"))).collect() == []


def test_language_is_its_own_attribute():
    pages = {
        '<html lang="en" data-lang="fr">': "en", '<html lang="en" xml:lang="de">': "en", "<html data-lang='fr' lang=es>": "es", '<html title="a > b" lang="pt">': "pt", "<html lang = 'it' >": "it",
        "<html title=\"lang='xx'\">": "", "<html lang>": "", "<html lang= class=x>": "class=x", '<html lang="">': "", "<html class='a lang=en'><html lang=nl>": "nl", '<html x="open lang=en>': "",
    }
    assert {p: warc.language_of(p) for p in pages} == pages


@pytest.mark.parametrize("page", ['<html x="' * 100_000, "<html a='b' " * 80_000, "<html " + "a=b " * 250_000, "<html '\"" * 100_000], ids=lambda p: p[:9])
def test_hostile_html_tags_are_read_in_linear_time(page):
    began = time.perf_counter()
    warc.language_of(page)
    assert time.perf_counter() - began < 2

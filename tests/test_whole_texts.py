"""Queries over whole texts against the raw tables, worked out plainly."""

import re

from docquarry.plans.catalogue import QUERIES
from docquarry.session import table
from tests.conftest import SF


def test_tag_filter(spark):
    ready = {r.doc_id for r in table(spark, SF, "labels").where("quality = 1 AND toxic = 0").collect()}
    want = {r.doc_id for r in table(spark, SF, "documents").collect() if r.doc_id in ready and {"the", "and"} <= set(re.split("[^a-z]+", r.text.lower()))}
    got = {r.document_id for r in QUERIES["tag_filter"](spark, SF).collect()}
    assert got == want


def test_spellings(spark):
    def words(text):
        first = {}
        for w in re.split("[ \n]+", text):
            if w:
                first.setdefault(w.lower(), w)
        return ",".join(list(first.values())[:12])

    got = {r.document_id: r.words for r in QUERIES["spellings"](spark, SF).collect()}
    assert got == {r.doc_id: words(r.text) for r in table(spark, SF, "documents").collect()}


def test_history_and_sources(spark):
    texts = {r.text for r in table(spark, SF, "conversations").collect()}
    shown = [r.shown for r in QUERIES["history"](spark, SF).collect()]
    assert set(shown) <= texts and max(map(len, shown)) > 80
    docs = {r.text for r in table(spark, SF, "documents").collect()}
    for r in QUERIES["sources_list"](spark, SF).collect():
        assert any(d in r.sources for d in docs if len(d) > 200)

"""The stemmer against published pairs, and the table of a corpus's terms."""

import re

import pytest

from docquarry.functions.stemmer import Stems, english
from docquarry.plans import indexed
from tests.conftest import SF

PAIRS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consolation consol
consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consonant conson conspicuous conspicu
conspicuously conspicu conspiracy conspiraci conspirator conspir conspired conspir constable constabl constancy constanc constant constant knack knack knavish knavish knead knead knee knee kneel kneel knees knee
knell knell knitting knit knives knive knocked knock knots knot knowing know known known generous generous generate generat generally general generic generic communication communic communism communism arsenal arsenal
skies sky dying die early earli news news inning inning proceed proceed exceeded exceed ties tie cries cri gas gas this this gaps gap kiwis kiwi hopping hop hoping hope hopefulness hope bed bed shed shed
luxuriated luxuri fitted fit owed owe say say by by cry cri enjoy enjoy rational ration relational relat analogously analog happily happili sensibility sensibl electrical electr adoption adopt controlling control
vietnamization vietnam youth youth boyish boyish flying fli agreed agre feed feed a a ab ab inc0042317 inc0042317 été été réunions réunion"""


@pytest.mark.parametrize(("term", "stem"), [pair for line in PAIRS.split("\n") for pair in zip(line.split()[::2], line.split()[1::2], strict=True)])
def test_published_pairs(term, stem):
    assert english(term) == stem


def test_a_stem_memo_is_bounded():
    stems = Stems(english, limit=3, longest=10)
    assert [stems[t] for t in ("running", "dogs", "cats", "walks", "incomprehensibilities")] == ["run", "dog", "cat", "walk", english("incomprehensibilities")]
    assert len(stems) <= 3


def test_every_term_of_the_corpus_is_stemmed_once(spark):
    rows = indexed.stemmed_terms(spark, SF).collect()
    held = {}
    for doc, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        for term in {t for t in re.split(r"[\W_]+", (text or "").lower()) if t}:
            held.setdefault(term, set()).add(doc)
    assert {(r.term, r.stem, r.n_documents) for r in rows} == {(t, english(t), len(d)) for t, d in held.items()}
    assert len(rows) == len(held)

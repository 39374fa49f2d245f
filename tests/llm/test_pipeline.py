"""The pipeline against its stages' rules worked out plainly from their own decisions."""

import pytest

import corpus_pipeline
from docquarry.llm import bpe, decontaminate, langid, toxicity
from docquarry.session import table
from tests.conftest import SF
from tests.llm import fixtures
from tests.llm.test_nearcopies import brute_roots


def test_run_equals_the_rules(spark):
    docs, labels, bench = table(spark, SF, "documents"), table(spark, SF, "labels"), table(spark, SF, "benchmark")
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    sure = {r.doc_id for r in langid.identify(docs).collect() if not r.ambiguous}
    left = docs.where(docs.doc_id.isin(sorted(sure)))
    toxic = {r.doc_id for r in toxicity.toxicity(left, labels).collect() if r.predicted}
    ids = sorted(sure - toxic)
    roots = brute_roots([texts[i] for i in ids])
    first = {ids[r] for r in roots}
    plain = lambda t: f" {' '.join(decontaminate.words_of(t))} "
    items = [plain(r.text) for r in bench.collect()]
    clean = {i for i in first if not any(x in plain(texts[i]) for x in items)}
    assert got == {i: len(bpe.tokenizer(bpe.default_path()).encode(texts[i])) for i in clean}


@pytest.mark.parametrize("make", [fixtures.odd, fixtures.empty])
def test_stages_take_odd_rows_and_keep_columns(spark, make):
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_near_dedup_keeps_one_of_each(spark):
    docs = table(spark, SF, "documents")
    texts = dict(sorted((r.doc_id, r.text) for r in docs.collect()))
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    ids = list(texts)
    assert kept == {ids[r] for r in brute_roots(list(texts.values()))}

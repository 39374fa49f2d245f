from docquarry.llm import licenses as L
from docquarry.session import table
from tests.conftest import SF
from tests.llm import fixtures


def brute(text):
    words = L.words_of(text)
    places, labels = [], set()
    for label, phrase in L.PHRASES.items():
        p = phrase.split(" ")
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def base(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels


def test_given_documents(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in L.scan(docs).collect()}
    assert {i: base(r) for i, r in rows.items()} == {d.doc_id: brute(d.text) for d in docs.collect()}
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels for r in rows.values())


def test_cases(spark):
    mit = L.TEMPLATES[0][1].split(" ")
    shifted = [*mit[:20], "indeed", *mit[20:33], *mit[34:]]
    texts = [
        None, "", "under the MIT license; under the mit license cc by nc by nc", "CC-BY-NC", "x " * 9 + "Apache License, Version 2",
        " ".join(shifted), " ".join(mit[:12]), "licensed under the gnu general public license version 3", "under the mit licence", "cc by nc " * 3000,
    ]
    rows = {r.doc_id: r for r in L.scan(fixtures.docs(spark, texts)).collect()}
    assert {i: base(r) for i, r in rows.items()} == {i: brute(t) for i, t in enumerate(texts, 1)}
    assert [rows[i].labels for i in range(1, 11)] == ["", "", "cc-by-nc,mit", "cc-by-nc", "apache-2", "mit", "", "gpl-3", "", "cc-by-nc"]
    assert rows[6].n_base == 0 and rows[6].score > 0.8 and 0 < rows[7].score < 0.6
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_order_and_length_of_spans_are_verified(spark):
    """A template's k-grams in another order, or drawn out without end, are no license; edited and whole ones are."""
    mit = L.TEMPLATES[0][1].split(" ")
    backwards = " ".join(" ".join(mit[p : p + 3]) for p in range(len(mit) - 3, -1, -1))
    drawn_out = " ".join(" ".join(mit[p : p + 3]) + " w x y z" for p in range(len(mit) - 2))
    whole = next(text for label, text in L.TEMPLATES if label == "zlib")
    edited = whole.split(" ")
    edited[30:32] = ["some", "new", "words"]
    rows = {r.doc_id: r for r in L.scan(fixtures.docs(spark, [backwards, drawn_out, whole, " ".join(edited)])).collect()}
    assert [rows[i].labels for i in (1, 2, 3, 4)] == ["", "", "zlib", "zlib"]
    assert rows[1].score < 0.6 and rows[3].score == 1.0 and 0.9 < rows[4].score < 1.0


def test_odd_rows(spark):
    rows = L.scan(fixtures.odd(spark)).collect()
    assert len(rows) == 11 and {r.labels for r in rows} == {""}
    assert sorted(r.n_words for r in rows if r.doc_id == 4) == [1, 1]
    assert L.scan(fixtures.empty(spark)).collect() == []


def test_a_whole_license_stays_where_its_words_come_again(spark):
    mit = L.TEMPLATES[0][1]
    texts = [f"{mit} {' of the software' * 60}", f"{'of the software ' * 60}{mit}", f"{mit}{' of the software' * 400} {mit}", "of the software " * 90]
    rows = {r.doc_id: r for r in L.scan(fixtures.docs(spark, texts)).collect()}
    assert [rows[i].labels for i in (1, 2, 3, 4)] == ["mit", "mit", "mit", ""]
    assert rows[1].score >= 0.95 and rows[4].score < 0.5

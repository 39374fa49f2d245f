import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.llm import bpe
from tests.conftest import SF
from tests.llm import fixtures

tokenizers = pytest.importorskip("tokenizers")
PATH = bpe.default_path()


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def same(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    own = bpe.tokenizer(PATH).encode(text)
    assert own.tolist() == ids
    assert bpe.tokenizer(PATH).decode(own) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", "  a", "a" * 300, "Hello <|endoftext|> wor<|startoftext|>ld's don'T I'LL", "ΟΔΟΣ ΣΑΣ", "İstanbul", "日本語 12345 ½²", "é ñ", "🙂🙂", "x y\r\nz", "<|endoftext|>" * 3])
def test_cases(library, text):
    same(library, text)


def test_every_code_point(library):
    """Each is split, lower-cased and encoded as the library does, between a letter and a digit."""
    texts = [f"a{chr(c)}B 1{chr(c)}" for c in range(0x40000) if not 0xD800 <= c < 0xE000]
    own = bpe.tokenizer(PATH)
    wrong = [t[1] for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True) if own.encode(t).tolist() != e.ids]
    assert not wrong, (len(wrong), wrong[:20])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdeinorst' -.éü0\n", max_size=60))
def test_any_text(text):
    same(tokenizers.Tokenizer.from_file(PATH), text) if not hasattr(test_any_text, "lib") else same(test_any_text.lib, text)


def test_gadgets_follow_the_merges():
    """Random small merge lists: the one accepted path is what merging in rank order gives."""
    rng = random.Random(2)
    for _ in range(60):
        names = ["a", "b", "c"]
        merges = []
        for _ in range(rng.randint(1, 9)):
            pair = rng.randrange(len(names)), rng.randrange(len(names))
            if names[pair[0]] + names[pair[1]] not in names:
                merges.append((*pair, len(names)))
                names.append(names[pair[0]] + names[pair[1]])
        auto = bpe.compile_merges([0, 1, 2], merges)
        for _ in range(40):
            word = [rng.randrange(3) for _ in range(rng.randint(1, 9))]
            want = list(word)
            for u, v, w in merges:
                i = 0
                while i < len(want) - 1:
                    if want[i : i + 2] == [u, v]:
                        want[i : i + 2] = [w]
                    i += 1
            text = "".join(names[x] for x in word)
            paths = [[]]
            found = []
            while paths:
                path = paths.pop()
                done = "".join(names[t] for t in path)
                if done == text:
                    found.append(path)
                    continue
                state = auto.target[path[-1]] if path else 0
                paths += [[*path, t] for t, n in enumerate(names) if text.startswith(done + n) and auto.has_arc(state, t)]
            assert found == [want]


def test_given_documents(spark, library):
    from docquarry.session import table

    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in bpe.encode(docs, PATH).collect()}
    assert len(rows) == docs.count()
    for d in docs.collect():
        ids = library.encode(d.text, add_special_tokens=False).ids
        r = rows[d.doc_id]
        assert (r.n_tokens, r.ids) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows_and_round_trip(spark):
    rows = bpe.encode(fixtures.odd(spark), PATH)
    got = rows.collect()
    assert len(got) == 11
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {0}
    again = bpe.decode(rows.drop("decoded"), PATH).select("doc_id", "decoded").collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in again) == sorted((r.doc_id or 0, r.decoded) for r in got)
    assert bpe.encode(fixtures.empty(spark), PATH).collect() == []

"""BPE by a tokenization automaton.

The automaton reads tokens. It starts as one state with an arc for each base
symbol. The gadget of the merge (u, v) -> w then changes it: all u-arcs that
led to state s now lead to a copy of s that lacks the v-arc, and each state
that had a u-arc gets a w-arc to where v led from s. After the last merge, a
token sequence is accepted just if it is what the merges make of its string,
so each string has one accepted path. Encoding finds that path: a byte trie
proposes arc labels, the automaton's tables admit or refuse them. Decoding
emits the arc labels.

Arcs are stored as what a state lacks: the arcs cut at it and when, and the
state it was copied from and when; an arc for a merged token exists if the arc
for its left part did when the merge came. Answers are kept in a table of
(state, token), so that a pair is worked out once in a worker.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import Memo, map_rows

NEVER = 1 << 60
#: Words of more characters than this aren't remembered.
MEMO_CHARS = 256

# fixed values: letters and numbers that are younger than the library's Unicode tables, as first and last code points
YOUNG_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959),
    (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
YOUNG_NUMBERS = ((0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16FF4, 0x16FF6))
# fixed values: lower case of letters that are younger than Python's tables, as first, last and lower first code points
YOUNG_CASES = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
_LOWER = {c: c - first + lower for first, last, lower in YOUNG_CASES for c in range(first, last + 1)}


def _finder(ranges) -> Callable[[str], object]:
    return re.compile("[" + "".join(f"{chr(r[0])}-{chr(r[1])}" for r in ranges) + "]").search


def _latin(text: str) -> bool:
    """Whether all code points are below 256; a quick test that passes over most texts."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_has_young, _has_young_case = _finder(YOUNG_LETTERS + YOUNG_NUMBERS), _finder(YOUNG_CASES)


def _without(kind: str, young: tuple[tuple[int, int], ...]) -> str:
    """A character class of the regex library without the code points that the tokenizers library doesn't know."""
    ranges = "".join(f"{chr(a)}-{chr(b)}" for a, b in young)
    return rf"[\p{{{kind}}}--[{ranges}]]"


@dataclass
class Automaton:
    """The tables; made once from the merges, then only read but for ``known``."""

    target: list[int]  # state that each token leads to
    parent: list[int] = field(default_factory=lambda: [-1])
    born: list[int] = field(default_factory=lambda: [-1])
    cuts: list[dict[int, int]] = field(default_factory=lambda: [{}])
    left: dict[int, int] = field(default_factory=dict)
    rank: dict[int, int] = field(default_factory=dict)
    never: set[int] = field(default_factory=set)  # merged tokens whose parts never come to stand side by side
    known: dict[int, bool] = field(default_factory=dict)

    def cut_at(self, state: int, token: int) -> int:
        """Rank of the merge that cut this arc, NEVER if none did."""
        before = NEVER
        while state >= 0:
            at = self.cuts[state].get(token)
            if at is not None and at < before:
                return at
            before = self.born[state] if self.born[state] < before else before
            state = self.parent[state]
        return NEVER

    def has_arc(self, state: int, token: int, at: int = NEVER - 1) -> bool:
        """Whether the arc exists just after the merge of rank ``at``."""
        while token not in self.never and self.cut_at(state, token) > at:
            if token not in self.left:
                return True
            at, token = self.rank[token], self.left[token]
        return False

    def admits(self, state: int, token: int) -> bool:
        key = state << 20 | token
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 1_000_000:
                self.known.clear()
            found = self.known[key] = self.has_arc(state, token)
        return found


def compile_merges(n_base: list[int], merges: list[tuple[int, int, int]]) -> Automaton:
    """Successive merge gadgets over (left, right, merged) token ids, in rank order."""
    size = max([*n_base, *(w for _, _, w in merges)], default=0) + 1
    auto = Automaton(target=[0] * size)
    sharing = [len(n_base) + 1]  # tokens that lead to a state; the start counts for state 0
    for rank, (u, v, w) in enumerate(merges):
        s = auto.target[u]
        if w in auto.left:
            raise ValueError(f"token {w} has two merges")
        auto.left[w], auto.rank[w], auto.target[w] = u, rank, auto.target[v]
        if u in auto.never or not auto.has_arc(s, v):
            auto.never.add(w)
            continue
        sharing[auto.target[v]] += 1
        if sharing[s] == 1:
            auto.cuts[s].setdefault(v, rank)
            continue
        sharing[s] -= 1
        auto.target[u] = len(sharing)
        sharing.append(1)
        auto.parent.append(s)
        auto.born.append(rank)
        auto.cuts.append({v: rank})
    return auto


class WordTokenizer:
    """A word-level BPE file: NFC, lower case, words without white space, </w> on a word's last byte."""

    #: fixed values of the file format: its word pattern and the byte-to-letter table's printable ranges
    LETTER, NUMBER = _without("L", YOUNG_LETTERS), _without("N", YOUNG_NUMBERS)
    PATTERN = r"\p{L}+|\p{N}|'(?:s|t|re|ve|m|ll|d)|[^\s\p{L}\p{N}]+"
    #: The same where a text has letters or numbers that the library doesn't know.
    YOUNG_PATTERN = rf"{LETTER}+|{NUMBER}|'(?:s|t|re|ve|m|ll|d)|(?:(?!{LETTER}|{NUMBER})\S)+"
    PRINTABLE = ((33, 126), (161, 172), (174, 255))

    def __init__(self, spec: dict):
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        shown = {b: chr(b) for lo, hi in self.PRINTABLE for b in range(lo, hi + 1)}
        hidden = (b for b in range(256) if b not in shown)
        shown |= {b: chr(256 + i) for i, b in enumerate(hidden)}
        byte_of = {c: b for b, c in shown.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = {a + b for a, b in pairs}
        self.auto = compile_merges([i for t, i in vocab.items() if t not in made], [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.labels: list[str] = [""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for label, i in [*vocab.items(), *self.special.items()]:
            self.labels[i] = label
        # trie of bytes: node -> {byte: node}; the tokens that end at a node inside and at the end of a word
        self.next: list[dict[int, int]] = [{}]
        self.inside, self.final = [-1], [-1]
        for label, i in vocab.items():
            last = label.endswith(end) and label != end
            node = 0
            for c in label.removesuffix(end) if last else label:
                step = self.next[node].get(byte_of[c])
                if step is None:
                    step = self.next[node][byte_of[c]] = len(self.next)
                    self.next.append({})
                    self.inside.append(-1)
                    self.final.append(-1)
                node = step
            (self.final if last else self.inside)[node] = i
        self.words, self.young_words = regex.compile(self.PATTERN).findall, regex.compile(self.YOUNG_PATTERN, regex.V1).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.memo = Memo(self._word, longest=MEMO_CHARS)

    def encode_word(self, word: bytes) -> list[int]:
        """The one accepted path that spells the word; longer labels are tried first.

        A place from which the end can't be reached is never tried twice, so
        the work is linear in the word's length.
        """
        n, admits, target = len(word), self.auto.admits, self.auto.target
        path: list[tuple[int, int, list]] = []
        dead: set[tuple[int, int]] = set()
        at, state, arcs = 0, 0, self._arcs(word, 0)
        while at < n:
            while arcs:
                token, to = arcs.pop()
                if admits(state, token) and (to, target[token]) not in dead:
                    path.append((at, token, arcs))
                    at, state = to, target[token]
                    arcs = self._arcs(word, at)
                    break
            else:
                dead.add((at, state))
                if not path:
                    raise ValueError(f"no path spells {word!r}")
                at, _, arcs = path.pop()
                state = target[path[-1][1]] if path else 0
        return [token for _, token, _ in path]

    def _arcs(self, word: bytes, at: int) -> list[tuple[int, int]]:
        node, out, last = 0, [], len(word) - 1
        for to in range(at, len(word)):
            node = self.next[node].get(word[to])
            if node is None:
                break
            token = self.final[node] if to == last else self.inside[node]
            if token >= 0:
                out.append((token, to + 1))
        return out

    def _piece(self, text: str) -> bytes:
        memo, words = self.memo, self.words
        if not text.isascii():
            # lower case is by letter, without the final form of sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if not _latin(text):
                text = text.translate(_LOWER) if _has_young_case(text) else text
                words = self.young_words if _has_young(text) else words
        words = words(text.lower())
        return b"".join([memo[w] for w in words])

    def _word(self, word: str) -> bytes:
        return np.array(self.encode_word(word.encode("utf-8", "surrogatepass")), "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids as the file's own library gives them without added tokens; special tokens in the text count as such."""
        if self.split is None or not any(s in text for s in self.special):
            return np.frombuffer(self._piece(text), "<u4")
        parts = [np.array([self.special[x]], "<u4").tobytes() if x in self.special else self._piece(x) for x in self.split(text)]
        return np.frombuffer(b"".join(parts), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.labels.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def tokenizer(path: str | None = None) -> WordTokenizer:
    """One compiled automaton for each Python worker and vocabulary file; without a path the file installed where the worker runs."""
    with open(path or default_path(), encoding="utf-8") as file:
        return WordTokenizer(json.load(file))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: str = "all") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and for keep="all" the ids and the decoded text.

    One row per input row. Null texts count as empty: no ids, an empty decoded
    text. Texts are encoded whole; repeated rows and ids stay; other columns
    are ignored. Each executor opens the vocabulary file that is installed there, or the one at ``path``.
    """
    more = keep == "all"

    def run(cols: dict[str, list]) -> dict[str, list]:
        tok = tokenizer(path)
        out: dict[str, list] = {"doc_id": cols["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
        for text in cols["text"]:
            ids = tok.encode(text or "")
            decoded = tok.decode(ids)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
            if more:
                out["ids"].append(ids.astype(np.int32))
                out["decoded"].append(decoded)
        return out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * more
    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), schema, run)


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """The input with ``decoded``, the text of the arc labels; null ids give null."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        tok = tokenizer(path)
        return cols | {"decoded": [None if ids is None else tok.decode(np.array(ids, np.int64)) for ids in cols[ids_col]]}

    kept = encoded.drop("decoded")
    return map_rows(kept, ", ".join(f"`{c}` {t}" for c, t in [*kept.dtypes, ("decoded", "string")]), run)

"""The English stemmer that is published as Porter2, for terms of letters and digits in lower case."""

from __future__ import annotations

import re
from collections.abc import Callable

# fixed values of the published algorithm: whole words, beginnings after which the first region starts, and endings by step
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
LEFT_ALONE = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
BEGINNINGS = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_region = re.compile("[aeiouy][^aeiouy]")
_vowel = re.compile("[aeiouy]")
_consonant_y = re.compile("(^|[aeiouy])y")
_short_end = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_longest = lambda endings: re.compile(f"({'|'.join(sorted(endings, key=len, reverse=True))})$")
_plural, _past = _longest(("sses", "ied", "ies", "us", "ss", "s")), _longest(("eed", "eedly", "ed", "edly", "ing", "ingly"))
_second, _third, _fourth = _longest(STEP2), _longest(STEP3), _longest(STEP4)


def _after(word: str, start: int) -> int:
    """Where a region begins: after the first consonant that follows a vowel."""
    found = _region.search(word, start)
    return found.end() if found else len(word)


def english(term: str) -> str:
    """The stem of one term. Terms of one or two characters are their own stems."""
    if len(term) < 3:
        return term
    if term in WHOLE:
        return WHOLE[term]
    word = _consonant_y.sub(lambda m: m[1] + "Y", term)
    first = next((len(b) for b in BEGINNINGS if word.startswith(b)), None) or _after(word, 0)
    second = _after(word, first)

    found = _plural.search(word)
    if found:
        end, stem = found[1], word[: found.start()]
        if end == "sses":
            word = stem + "ss"
        elif end in ("ied", "ies"):
            word = stem + ("i" if len(stem) > 1 else "ie")
        elif end == "s" and _vowel.search(stem[:-1]):
            word = stem
    if word in LEFT_ALONE:
        return word

    found = _past.search(word)
    if found:
        end, stem = found[1], word[: found.start()]
        if end in ("eed", "eedly"):
            if found.start() >= first:
                word = stem + "ee"
        elif _vowel.search(stem):
            word = stem
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word.endswith(DOUBLES):
                word = word[:-1]
            elif first >= len(word) and _short_end.search(word):
                word += "e"
    if word[-1] in "yY" and len(word) > 2 and word[-2] not in "aeiouy":
        word = word[:-1] + "i"

    found = _second.search(word)
    if found and found.start() >= first:
        end, stem = found[1], word[: found.start()]
        if (end != "ogi" or stem.endswith("l")) and (end != "li" or stem[-1:] in tuple("cdeghkmnrt")):
            word = stem + STEP2[end]
    found = _third.search(word)
    if found and found.start() >= (second if found[1] == "ative" else first):
        word = word[: found.start()] + STEP3[found[1]]
    found = _fourth.search(word)
    if found and found.start() >= second and (found[1] != "ion" or word[: found.start()].endswith(("s", "t"))):
        word = word[: found.start()]

    if word.endswith("e"):
        if len(word) - 1 >= second or len(word) - 1 >= first and not _short_end.search(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= second:
        word = word[:-1]
    return word.replace("Y", "y")


class Stems(dict):
    """Stems of the terms met by one task, each worked out once; emptied at ``limit`` terms, and long terms aren't kept."""

    def __init__(self, stem: Callable[[str], str], limit: int = 500_000, longest: int = 64):
        super().__init__()
        self._stem, self._limit, self._longest = stem, limit, longest

    def __missing__(self, term: str) -> str:
        made = self._stem(term)
        if len(term) <= self._longest:
            if len(self) >= self._limit:
                self.clear()
            self[term] = made
        return made

"""Column expressions over text: token estimates, sentences, terms. White space is Unicode's throughout."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: characters and tokens of a word, Unicode's white space, sentence boundary
CHARS_PER_TOKEN = 3.5
TOKENS_PER_WORD = 1.3
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SENTENCE_BOUNDARY = r"(?U)(?<=[.!?])\s+(?=[A-Z0-9])|\n{2,}"


def token_count(text: Column) -> Column:
    """The larger of two estimates, by characters and by words; 0 for empty, else 1 at least."""
    by_chars = F.length(text) / F.lit(CHARS_PER_TOKEN)
    by_words = F.regexp_count(text, F.lit(r"(?U)\S+")) * F.lit(TOKENS_PER_WORD)
    size = F.ceil(F.greatest(by_chars, by_words)).cast("int")
    return F.when(F.length(text) > 0, F.greatest(F.lit(1), size)).otherwise(F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at either end; a run of blanks inside costs its length once."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def sentences(text: Column) -> Column:
    """Non-empty stripped sentences; a blank line ends one too."""
    return F.filter(F.transform(F.split(text, SENTENCE_BOUNDARY), strip), lambda s: s != "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def term_frequency(lowered: Column, term: str) -> Column:
    """How often a term of letters and digits stands in a lower-case text, as ``terms`` would cut it."""
    edge = r"[\p{L}\p{N}]"
    plain = re.sub(r"([^\w\s])", r"\\\1", term)
    return F.regexp_count(lowered, F.lit(rf"(?<!{edge}){plain}(?!{edge})"))


def slug_ok(slug: Column) -> Column:
    return F.lower(F.trim(slug)).rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$")

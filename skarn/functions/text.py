"""Tokens of a text column, as arrays inside the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word (letters, marks and digits, joined by apostrophes, hyphens, or by points and commas
# inside a number), or a single other sign. Common to Java and RE2 patterns.
WORD = r"[\p{L}\p{M}\p{N}]+"
TOKEN = rf"\p{{N}}+(?:[.,]\p{{N}}+)+|{WORD}(?:[-]{WORD})*|'(?:s|S|m|M|d|D|ll|LL|re|RE|ve|VE)|[^\s\p{{L}}\p{{M}}\p{{N}}]"

# A negative contraction is two tokens: "don't" gives "do" and "n't".
NOT_CONTRACTION = r"([\p{L}])([nN]['’][tT])($|[^\p{L}\p{M}\p{N}])"

# Runs of two or more characters other than white space.
CHUNK = r"[^\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]{2,}"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def tokenize(text: Column) -> Column:
    """Word and punctuation tokens in reading order; a text without any gives an empty array."""
    spaced = F.regexp_replace(text, NOT_CONTRACTION, "$1 $2$3")
    return F.regexp_extract_all(spaced, F.lit(rf"[nN]['’][tT]|{TOKEN}"), F.lit(0))


def sentiment_words(text: Column) -> Column:
    """White-space words of two or more characters, freed from punctuation at either end.

    A word of which the punctuation leaves less than two characters stays as it is, which
    keeps emoticons.
    """
    chunks = F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))
    return F.transform(chunks, _bare)


def _bare(word: Column) -> Column:
    bare = F.btrim(word, F.lit(PUNCTUATION))
    return F.when(F.length(bare) > 1, bare).otherwise(word)


def is_upper(word: Column) -> Column:
    """Has a cased letter and no lower-case one."""
    return (word == F.upper(word)) & (word != F.lower(word))


def count_of(text: Column, sign: str) -> Column:
    """Occurrences of a single character."""
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))

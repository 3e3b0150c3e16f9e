"""Text expressions: characters, words, sentences, special-token framing.
All JVM-side (split / regexp_extract_all / higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: token patterns and special tokens
WORD_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
SENTENCE_BOUNDARY = r"(?<=[.!?])\s+(?=\p{Lu})"
PAD, CLS, SEP, EOS, MASK = "<PAD>", "[CLS]", "[SEP]", "[EOS]", "[MASK]"
IGNORE_INDEX = -100


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def chars(text) -> Column:
    """Characters of a string as an array (accents/newlines kept); an empty
    string gives an empty array."""
    t = _c(text)
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.split(t, ""))


def words(text) -> Column:
    """Word and punctuation tokens, case kept."""
    return F.regexp_extract_all(_c(text), F.lit(WORD_PATTERN), 0)


def sentences(text) -> Column:
    """Split after end punctuation when whitespace and a capital follow."""
    return F.split(_c(text), SENTENCE_BOUNDARY)


def char_class(c: Column) -> Column:
    """Per-character label: L = letter, S = whitespace, O = other."""
    return F.when(c.rlike(r"^\p{L}$"), "L").when(c.rlike(r"^\s$"), "S").otherwise("O")


def char_classes(text) -> Column:
    """The class letter of every character of a string, as a string of the
    same length, by whole-string regex replacement (no per-character work):
    other -> U+0001, letters -> U+0002, whitespace -> U+0003, then one
    translate to O / L / S."""
    t = _c(text)
    t = F.regexp_replace(t, r"[^\p{L}\s]", "\u0001")
    t = F.regexp_replace(t, r"\p{L}", "\u0002")
    t = F.regexp_replace(t, r"\s", "\u0003")
    return F.translate(t, "\u0001\u0002\u0003", "OLS")


def frame_pair(a, b) -> Column:
    """[CLS] A [SEP] B [SEP]"""
    return F.concat_ws(" ", F.lit(CLS), _c(a), F.lit(SEP), _c(b), F.lit(SEP))


def frame_single(a) -> Column:
    """A [EOS]"""
    return F.concat_ws(" ", _c(a), F.lit(EOS))

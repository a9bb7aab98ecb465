"""Words between ASCII separators, as columns: A-Z in lower case, other letters as they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # every ASCII character but digits, a-z and A-Z
AS_SEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same before letters are lowered


def lowered(word: Column) -> Column:
    """A-Z only; ``lower`` is much quicker than ``translate`` and equals it on ASCII."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def pieces(text: Column) -> Column:
    """What stands between separators; only the first and the last piece can be empty."""
    return F.split(F.coalesce(text, F.lit("")), AS_SEEN)


def words(text: Column) -> Column:
    """All words of a text, in order."""
    return F.transform(F.filter(pieces(text), lambda w: w != ""), lowered)


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once a row, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def n_words(text: Column) -> Column:
    return bound(pieces(text), lambda p: (F.size(p) - F.when(p[0] == "", 1).otherwise(0) - F.when(
        (F.size(p) > 1) & (F.element_at(p, -1) == ""), 1).otherwise(0)).cast("long"))

"""Words and other small expressions that the native text operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space is \x20 and \x09-\x0D only; everything else belongs to words.
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, even where a lambda uses it often."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the words of ``text`` (none for null)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def count_chars(text: Column, inside: str) -> Column:
    """How many code points of ``text`` are in the regular expression's class ``[inside]``."""
    return F.length(F.regexp_replace(text, f"[^{inside}]+", ""))

"""Column expressions shared by the text operators; all built from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word is a run of characters other than the space and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of ``text`` in order; an empty array for null, empty or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")

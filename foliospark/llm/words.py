"""Columns shared by the operators on running text.

A word is a maximal run without space, tab, line feed, vertical tab, form feed or carriage return. A null text counts
as an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
GAP = "[\\x20\\x09-\\x0D]+"


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text."""
    body = F.trim(text, F.lit(SPACES))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, GAP))


def word_count(text: Column) -> Column:
    body = F.trim(text, F.lit(SPACES))
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, GAP))).cast("long")



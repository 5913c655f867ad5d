"""Tokens of a text: lower case, runs of letters and digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_BREAK = r"[^\p{L}\p{N}]+"
#: Longest stored term or document name, in characters.
MAX_NAME = 255


def tokens(text: Column) -> Column:
    """array<string> of a text's terms in order; null and blank texts have none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_BREAK), "")


def name(value: Column) -> Column:
    return F.substring(value, 1, MAX_NAME)

"""Shared helpers: words, row identity, and the library's tables and scratch storage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..storage import BROADCAST_ROWS, scratch, shared_dir, small, table, written  # noqa: F401

#: White space of the operators' contracts: a blank and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows with a null id share this place, after all others.
LAST = 2**63 - 1


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else.  Pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def place(id_col: str | Column) -> Column:
    """Id for comparisons, nulls last."""
    return F.coalesce(F.col(id_col) if isinstance(id_col, str) else id_col, F.lit(LAST))


def identity(text: Column) -> Column:
    """Tells apart rows that share an id but not a text; equal rows get equal results."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.octet_length(F.coalesce(text, F.lit(""))))

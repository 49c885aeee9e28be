"""Column expressions shared by the operators that run on Spark's own functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body).getItem(0)


def ascii_words(text: Column) -> Column:
    """Runs of characters other than space and 0x09 to 0x0D."""
    return F.array_remove(F.split(text, "[ \\t-\\r]+"), "")

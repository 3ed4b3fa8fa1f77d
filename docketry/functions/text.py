"""Text helpers that follow Unicode where Spark's defaults are ASCII."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space by the Unicode property, with the four separators that Python's strip also takes.
SPACE = r"[\p{IsWhite_Space}\x1C-\x1F]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return strip(F.regexp_replace(c, f"{SPACE}+", " "))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def present(c: Column) -> Column:
    """Null and empty text alike count as absent."""
    return F.coalesce(c, F.lit("")) != ""

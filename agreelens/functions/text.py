"""String helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import PY_WHITESPACE


def py_strip(col: Column) -> Column:
    """Strip all whitespace at both ends; SQL ``trim`` alone would keep newlines and tabs.

    A trim with a character set walks through the whole text, so it runs only where an end needs it.
    """
    spaces = list(PY_WHITESPACE)
    needed = F.substring(col, 1, 1).isin(spaces) | F.substring(col, -1, 1).isin(spaces)
    return F.when(needed, F.btrim(col, F.lit(PY_WHITESPACE))).otherwise(col)


def nonblank(col: Column) -> Column:
    return py_strip(col) != ""


def path_safe(col: Column) -> Column:
    """A model name usable as one path segment."""
    return F.replace(col, F.lit("/"), F.lit("_"))


def fixed_point(col: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, for sinks only; keep doubles until then."""
    return F.format_string(f"%.{digits}f", col)


def literal_map(values: dict) -> Column:
    """A small dict as a map literal."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])

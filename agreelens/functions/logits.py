"""Numerically safe log-sum-exp, softmax and arg-max over a short, fixed label list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_sum_exp(values: Column) -> Column:
    """Log-sum-exp of an ``array<double>``, shifted by its maximum; NULL for an empty array."""
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.when(top == float("-inf"), F.lit(float("-inf"))).otherwise(top + F.ln(total))


def softmax(columns: Sequence[Column]) -> list[Column]:
    """Softmax across columns of one row. Infinite maxima share the mass equally among themselves."""
    top = F.greatest(*columns)
    shifted = [F.when(c == top, F.lit(0.0)).otherwise(c - top) for c in columns]
    total = sum((F.exp(s) for s in shifted[1:]), F.exp(shifted[0]))
    return [F.exp(s) / total for s in shifted]


def first_max(columns: Sequence[Column], labels: Sequence[str]) -> Column:
    """Label of the largest column; the earlier label wins a tie."""
    top = F.greatest(*columns)
    out = F.lit(None).cast("string")
    for c, label in reversed(list(zip(columns, labels))):
        out = F.when(c == top, F.lit(label)).otherwise(out)
    return out

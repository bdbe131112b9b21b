"""Driver-side checks on columns and inputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def require_rows(df: DataFrame, what: str = "input") -> DataFrame:
    """Fails on an empty input; looks at one row only."""
    if df.isEmpty():
        raise ValueError(f"no rows found in {what}")
    return df


def resolve_column(df: DataFrame, name: str, contains: Sequence[str] = ()) -> str:
    """The column called ``name``, else the first whose lower-case name contains one of ``contains``."""
    if name in df.columns:
        return name
    for column in df.columns:
        if any(part.lower() in column.lower() for part in contains):
            return column
    raise ValueError(f"no column {name!r} and none containing {list(contains)}")


def rename_unnamed_index(df: DataFrame, to: str = "item_index") -> DataFrame:
    """Rename a first column without a header (read as ``_c0`` or blank)."""
    first = df.columns[0]
    return df.toDF(to, *df.columns[1:]) if first == "_c0" or not first.strip() else df


def add_missing_columns(df: DataFrame, defaults: Mapping[str, str]) -> DataFrame:
    """Add NULL columns of the given types where the table lacks them."""
    for name, data_type in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(data_type))
    return df

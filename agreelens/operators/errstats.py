"""Which item features go with errors: correlations, chi-square, Cramér's V, error rates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from ..functions.pvalues import chi2_p_value, correlation_p_value
from ..functions.text import py_strip
from .joins import splittable_join


def _name(column: str) -> Column:
    # Feature names may contain dots.
    return F.col(f"`{column}`")


def _present(df: DataFrame, features: Sequence[str] | Mapping[str, Column]) -> dict[str, Column]:
    """Requested features as columns; names that the table lacks are skipped."""
    if isinstance(features, Mapping):
        return dict(features)
    return {f: _name(f) for f in features if f in df.columns}


def add_error_flag(df: DataFrame, correct: str = "is_correct", out: str = "error_flag") -> DataFrame:
    return df.withColumn(out, (~F.col(correct)).cast("int"))


def numeric(col: Column) -> Column:
    """The value as a double; NULL for text that is no number and for NaN."""
    value = col.try_cast("double")
    return F.when(~F.isnan(value), value)


def category(col: Column) -> Column:
    """The trimmed value as text; NULL for empty text and ``nan``."""
    value = py_strip(col.cast("string"))
    return F.when((value != "") & (value != "nan"), value)


def numeric_correlations(
    df: DataFrame,
    features: Sequence[str] | Mapping[str, Column] = NUMERIC_FEATURES,
    keys: Sequence[str] = (),
    error: str = "error_flag",
) -> DataFrame:
    """Point-biserial r and pair count per feature; without any of the features in the table, no rows.

    One aggregate over the data with one ``corr`` per feature; only its single result row per key set is
    turned into feature rows, so the data is not multiplied by the number of features.
    """
    found = _present(df, features)
    if not found:
        # An empty section with its columns, as where features are present but have no values.
        return df.select(*keys, F.lit("").alias("feature"), F.lit(0.0).alias("correlation"), F.lit(0).cast("bigint").alias("n")).limit(0)
    flag = F.col(error).cast("double")
    rows = [
        F.struct(
            F.lit(name).alias("feature"),
            F.corr(flag, numeric(col)).alias("correlation"),
            F.count(F.when(flag.isNotNull(), numeric(col))).alias("n"),
        )
        for name, col in found.items()
    ]
    out = df.groupBy(*keys).agg(F.array(*rows).alias("_rows")).select(*keys, F.inline("_rows"))
    return out.filter(F.col("n") > 0)


def with_correlation_p(correlations: DataFrame) -> DataFrame:
    return correlations.withColumn(
        "p_value", correlation_p_value(F.col("correlation"), F.col("n").cast("double"))
    )


def contingency(
    df: DataFrame,
    features: Sequence[str] | Mapping[str, Column] = CATEGORICAL_FEATURES,
    keys: Sequence[str] = (),
    error: str = "error_flag",
) -> DataFrame:
    """Errors and non-errors per feature value: all features in one pass and one shuffle; without any of them in the table, no rows.

    A feature may be raw text with as many values as rows, so nothing downstream gathers the values of one
    feature in one place.
    """
    found = _present(df, features)
    if not found:
        none = F.lit(0).cast("bigint")
        return df.select(*keys, F.lit("").alias("feature"), F.lit("").alias("value"), none.alias("errors"), none.alias("non_errors")).limit(0)
    pairs = F.array(
        *[F.struct(F.lit(name).alias("feature"), category(col).alias("value")) for name, col in found.items()]
    )
    long = df.select(*keys, F.col(error).alias("_err"), F.inline(pairs))
    # Rows without a flag count for no value, so a value with no other rows does not appear.
    long = long.filter(F.col("value").isNotNull() & F.col("_err").isNotNull())
    return long.groupBy(*keys, "feature", "value").agg(
        F.count_if(F.col("_err") == 1).alias("errors"), F.count_if(F.col("_err") == 0).alias("non_errors")
    )


def error_rates(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Error rate and support per feature value."""
    support = F.col("errors") + F.col("non_errors")
    return table.select(
        *keys, "feature", "value", F.try_divide("errors", support).alias("error_rate"), support.alias("support")
    )


def ranked_error_rates(
    rates: DataFrame, keys: Sequence[str] = (), min_support: int = 5, skip: Sequence[str] = ("Target",)
) -> DataFrame:
    """Values with enough support, sorted by falling error rate within each feature.

    A global sort is range-partitioned, so a feature with very many values is spread over tasks, which a
    rank window per feature would not do. Raw-text features are left out by name.
    """
    return rates.filter((F.col("support") >= min_support) & ~F.col("feature").isin(*skip)).orderBy(
        *keys, "feature", F.desc("error_rate"), "value"
    )


def chi_square(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Chi-square test of each feature against the error flag, with Yates' correction at one degree of freedom.

    Features with fewer than two values or without both outcomes are left out. The totals (one row per
    feature) are joined back to the table of values; both branches read the same shuffle. A feature of raw
    text is a hot key of that join.
    """
    by = [*keys, "feature"]
    totals = (
        table.groupBy(*by)
        .agg(
            F.sum("errors").alias("_e"),
            F.sum("non_errors").alias("_o"),
            F.count(F.lit(1)).alias("value_count"),
        )
        .filter((F.col("value_count") > 1) & (F.col("_e") > 0) & (F.col("_o") > 0))
        .withColumn("n", F.col("_e") + F.col("_o"))
    )
    if not keys:
        totals = F.broadcast(totals)  # at most one row per requested feature
    row_total = (F.col("errors") + F.col("non_errors")).cast("double")

    def term(observed: Column, column_total: Column) -> Column:
        expected = row_total * column_total / F.col("n")
        gap = F.abs(observed - expected)
        gap = F.when(F.col("value_count") == 2, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
        return gap * gap / expected

    cell = term(F.col("errors"), F.col("_e")) + term(F.col("non_errors"), F.col("_o"))
    return (
        splittable_join(table, totals, by)
        .groupBy(*by)
        .agg(F.sum(cell).alias("chi2"), F.first("n").alias("n"), F.first("value_count").alias("value_count"))
        .withColumn("dof", F.col("value_count") - 1)
    )


def with_chi2_p(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p_value", chi2_p_value(F.col("chi2"), F.col("dof").cast("double")))


def with_cramers_v(tests: DataFrame) -> DataFrame:
    """Bias-corrected Cramér's V from chi-square, for a table with two outcome columns."""
    n1 = (F.col("n") - 1).cast("double")
    rows, cols = F.col("value_count").cast("double"), F.lit(2.0)
    phi2 = F.greatest(F.lit(0.0), F.col("chi2") / F.col("n") - (cols - 1) * (rows - 1) / n1)
    smaller = F.least(
        (cols - (cols - 1) * (cols - 1) / n1) - 1, (rows - (rows - 1) * (rows - 1) / n1) - 1
    )
    return tests.withColumn(
        "cramers_v", F.when(smaller == 0, F.lit(0.0)).otherwise(F.sqrt(F.try_divide(phi2, smaller)))
    )

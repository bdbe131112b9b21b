"""Classification metrics for any number of models, splits and runs at once.

The data is shuffled once, into ``confusion_counts``: at most (labels + 2)^2 rows per key set, after map-side
combine. Every metric is derived from that small table, so asking for more metrics costs no more scans.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import LABELS, UNKNOWN
from ..functions.labels import error_type


def confusion_counts(
    df: DataFrame, gold: str = "gold_label", pred: str = "predicted_label", keys: Sequence[str] = ()
) -> DataFrame:
    """Rows per ``keys, gold, pred``. NULLs and labels outside the label list stay."""
    return df.groupBy(*keys, F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def roll_up(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts over fewer keys, e.g. all strata together."""
    return counts.groupBy(*keys, "gold", "pred").agg(F.sum("n").alias("n"))


# The formulas below are SQL text: many small terms per label, each parsed in one go, which keeps building the
# plan for several strata and labels cheap on the driver.


def literal(value: str | int) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def _count(condition: str) -> str:
    return f"coalesce(sum(CASE WHEN {condition} THEN n END), 0L)"


def _ratio(top: str, bottom: str) -> str:
    # An empty denominator gives 0.0, never NULL.
    return f"coalesce(try_divide(CAST({top} AS DOUBLE), CAST({bottom} AS DOUBLE)), 0D)"


def _f1(precision: str, recall: str) -> str:
    return _ratio(f"2 * ({precision} * {recall})", f"({precision} + {recall})")


def _total(terms: Sequence[str]) -> str:
    return "(" + " + ".join(terms) + ")"


def cells(labels: Sequence, where: str = "true") -> dict[str, str]:
    """Counts from which every metric follows, over the rows of ``counts`` that satisfy ``where``."""
    out = {
        "num_examples": _count(where),
        "num_with_gold": _count(f"{where} AND gold IS NOT NULL"),
        "unknown_prediction_count": _count(f"{where} AND pred IS NULL"),
        "correct": _count(f"{where} AND gold = pred"),
        "same": _count(f"{where} AND gold <=> pred"),
    }
    for i, label in enumerate(map(literal, labels)):
        out[f"tp{i}"] = _count(f"{where} AND gold = {label} AND pred = {label}")
        out[f"predicted{i}"] = _count(f"{where} AND pred = {label}")
        out[f"support{i}"] = _count(f"{where} AND gold = {label}")
    return out


def named_struct(fields: Mapping[str, str]) -> str:
    return "named_struct(" + ", ".join(f"{literal(name)}, {value}" for name, value in fields.items()) + ")"


def metrics(wide: DataFrame, labels: Sequence, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Metrics from one row of ``cells`` per key set: plain arithmetic, no further shuffle."""
    every = range(len(labels))
    tp, predicted, support, f1 = ([f"{x}{i}" for i in every] for x in ("tp", "predicted", "support", "f1_"))
    present = [f"(support{i} > 0 OR predicted{i} > 0)" for i in every]
    rates = wide.selectExpr(
        "*",
        *[f"{_ratio(tp[i], predicted[i])} AS precision{i}" for i in every],
        *[f"{_ratio(tp[i], support[i])} AS recall{i}" for i in every],
        f"{_ratio(_total(tp), _total(predicted))} AS micro_precision",
        f"{_ratio(_total(tp), _total(support))} AS micro_recall",
    )
    scored = rates.selectExpr("*", *[f"{_f1(f'precision{i}', f'recall{i}')} AS f1_{i}" for i in every])
    classes = [
        named_struct(
            {
                "label": literal(label),
                "tp": f"tp{i}",
                "fp": f"predicted{i} - tp{i}",
                "fn": f"support{i} - tp{i}",
                "support": f"support{i}",
                "predicted": f"predicted{i}",
                "precision": f"precision{i}",
                "recall": f"recall{i}",
                "f1": f"f1_{i}",
            }
        )
        for i, label in enumerate(labels)
    ]
    present_f1 = _total([f"IF({present[i]}, {f1[i]}, 0D)" for i in every])
    n_present = _total([f"CAST({p} AS INT)" for p in present])
    return scored.selectExpr(
        *[f"`{k}`" for k in keys],
        "num_examples",
        "num_with_gold",
        "unknown_prediction_count",
        "correct",
        f"{_ratio('same', 'num_examples')} AS accuracy_all",
        f"{_ratio('correct', 'num_with_gold')} AS accuracy_known",
        f"{_total(f1)} / {len(labels)} AS macro_f1",
        f"{_ratio(present_f1, n_present)} AS macro_f1_present",
        "micro_precision",
        "micro_recall",
        f"{_f1('micro_precision', 'micro_recall')} AS micro_f1",
        f"{_ratio(_total([f'{f1[i]} * {support[i]}' for i in every]), _total(support))} AS weighted_f1",
        f"array({', '.join(classes)}) AS per_class",
        *extra,
    )


def classification_report(
    counts: DataFrame,
    labels: Sequence = LABELS,
    keys: Sequence[str] = (),
    strata: Sequence[str] = (),
    stratum: str = "entropy_class",
) -> DataFrame:
    """One row per key set: accuracy, F1 averages and the array ``per_class``.

    Both accuracy rules are given: ``accuracy_all`` divides by all rows and takes two missing labels as
    equal, ``accuracy_known`` looks at rows with gold only. Likewise ``macro_f1`` divides by the length of
    the label list and ``macro_f1_present`` by the labels that occur as gold or prediction.

    With ``strata`` there is one row per key set and listed value of ``stratum``, zeros included.
    """
    if not strata:
        every = [F.expr(value).alias(name) for name, value in cells(labels).items()]
        return metrics(counts.groupBy(*keys).agg(*every), labels, keys)
    scopes = [
        named_struct({stratum: literal(s), **cells(labels, f"`{stratum}` = {literal(s)}")}) for s in strata
    ]
    return metrics(_rows_per_key(counts, keys, scopes), labels, [*keys, stratum])


def _rows_per_key(counts: DataFrame, keys: Sequence[str], structs: Sequence[str]) -> DataFrame:
    """One aggregate per key set whose structs become rows: fixed scaffolds with zeros, and no join."""
    rows = F.expr(f"array({', '.join(structs)})").alias("_rows")
    return counts.groupBy(*keys).agg(rows).select(*keys, F.inline("_rows"))


def per_class(report: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per label: tp, fp, fn, support, precision, recall, f1. Absent labels have zeros."""
    return report.select(*keys, F.inline("per_class"))


def confusion_matrix(counts: DataFrame, labels: Sequence = LABELS, keys: Sequence[str] = ()) -> DataFrame:
    """A row per gold label and a column per prediction; other and missing labels are left out."""
    rows = []
    for g in labels:
        row = {f"pred_{p}": _count(f"gold = {literal(g)} AND pred = {literal(p)}") for p in labels}
        rows.append(named_struct({"gold": literal(g), **row}))
    return _rows_per_key(counts, keys, rows)


def prediction_counts(
    counts: DataFrame,
    labels: Sequence = LABELS,
    keys: Sequence[str] = (),
    unknown_values: Sequence[str] = (UNKNOWN,),
) -> DataFrame:
    """Predictions per label, with zeros, and missing ones as ``UNKNOWN``."""
    rows = [named_struct({"label": literal(x), "n": _count(f"pred = {literal(x)}")}) for x in labels]
    missing = " OR ".join(["pred IS NULL", *[f"pred = {literal(x)}" for x in unknown_values]])
    rows.append(named_struct({"label": literal("UNKNOWN"), "n": _count(missing)}))
    return _rows_per_key(counts, keys, rows)


def label_distribution(counts: DataFrame, labels: Sequence = LABELS, keys: Sequence[str] = ()) -> DataFrame:
    """Gold and predicted rows per label, with zeros."""
    rows = [
        named_struct(
            {
                "label": literal(x),
                "gold_n": _count(f"gold = {literal(x)}"),
                "pred_n": _count(f"pred = {literal(x)}"),
            }
        )
        for x in labels
    ]
    return _rows_per_key(counts, keys, rows)


def error_types(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per kind of error."""
    wrong = counts.filter(~F.col("gold").eqNullSafe(F.col("pred")))
    kind = error_type(F.col("gold"), F.col("pred"))
    return wrong.groupBy(*keys, kind.alias("error_type")).agg(F.sum("n").alias("n"))


def top_errors(errors: DataFrame, keys: Sequence[str], k: int = 3) -> DataFrame:
    """The k most frequent error types per key set; equal counts are ordered by name.

    The rank filter is applied per partition before the shuffle (window group limit).
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc("error_type"))
    return errors.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def majority_class(df: DataFrame, label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """The most frequent class per key set; the lowest class wins a tie."""
    counted = df.groupBy(*keys, F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    top = F.max_by(F.struct("label", "n"), F.struct(F.col("n"), (-F.col("label")).alias("low")))
    return counted.groupBy(*keys).agg(top.alias("_top")).select(
        *keys, F.col("_top.label").alias("majority"), F.col("_top.n").alias("support")
    )

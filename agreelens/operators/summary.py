"""Nested summary documents, one row per key set, built from confusion counts.

Each document comes from a single aggregate over the counts. Assembling it from several operators by join
would evaluate the counts, and the join with gold below them, once per part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import HIGH_ENTROPY, LABELS, LETTERS, LOW_ENTROPY
from ..functions.labels import error_type
from .metrics import cells, classification_report, literal, metrics, named_struct

STRATA = (LOW_ENTROPY, HIGH_ENTROPY)
_ALL = "all"


def _class_map(fields: Sequence[str]) -> Column:
    entry = lambda c: F.struct(c["label"], F.struct(*[c[f].alias(f) for f in fields]))
    return F.map_from_entries(F.transform("per_class", entry))


def _label_map(field: str) -> Column:
    return F.map_from_entries(F.transform("per_class", lambda c: F.struct(c["label"], c[field])))


def _error_map(errors: Column) -> Column:
    """A short list of ``(error_type, n)`` as a map, equal types added up."""
    types = F.array_distinct(F.transform(errors, lambda e: e["error_type"]))
    total = lambda t: F.aggregate(
        F.filter(errors, lambda e: e["error_type"] == t), F.lit(0).cast("bigint"), lambda acc, e: acc + e["n"]
    )
    return F.map_from_arrays(types, F.transform(types, total))


def evaluation_summary(
    counts: DataFrame,
    labels: Sequence[str] = LABELS,
    keys: Sequence[str] = (),
    stratum: str | None = None,
    strata: Sequence[str] = STRATA,
    model: str | Column | None = None,
    predictions_file: str | Column | None = None,
) -> DataFrame:
    """``keys, summary``: accuracy, averages, per-class metrics and label distribution as one JSON document.

    With ``stratum`` (a column of ``counts``) the document also has a breakdown by it, with error counts. ``model`` and
    ``predictions_file`` are named in it if given, as text or as an expression over ``keys``.
    """
    pair = counts.withColumn("_type", error_type(F.col("gold"), F.col("pred")))

    def scope(name: str, where: str) -> str:
        # At most one list entry per pair of labels.
        kind = named_struct({"error_type": "_type", "n": "n"})
        errors = f"collect_list(CASE WHEN {where} AND NOT gold <=> pred THEN {kind} END)"
        return named_struct({"_scope": literal(name), **cells(labels, where), "_errors": errors})

    scopes = [scope(_ALL, "true")]
    if stratum:
        scopes += [scope(s, f"`{stratum}` = {literal(s)}") for s in strata]
    rows = F.expr(f"array({', '.join(scopes)})").alias("_scopes")
    wide = pair.groupBy(*keys).agg(rows).select(*keys, F.inline("_scopes"))
    scored = metrics(wide, labels, [*keys, "_scope"], extra=["_errors"])
    parts = scored.select(
        *keys,
        "_scope",
        F.struct(
            "num_examples", "num_with_gold", F.col("accuracy_all").alias("accuracy"), "macro_f1", "micro_f1",
            "weighted_f1", F.col("correct").alias("correct_predictions"),
            _class_map(["precision", "recall", "f1", "support"]).alias("per_class_metrics"),
            F.struct(_label_map("support").alias("gold"), _label_map("predicted").alias("predictions")).alias(
                "label_distribution"
            ),
        ).alias("_overall"),
        F.struct(
            F.col("num_examples").alias("total"), F.col("accuracy_all").alias("accuracy"),
            F.col("macro_f1_present").alias("macro_f1"), "micro_f1",
            _class_map(["f1", "precision", "recall", "support"]).alias("per_class_metrics"),
            _error_map(F.col("_errors")).alias("errors"),
        ).alias("_part"),
    )
    is_all = F.col("_scope") == _ALL
    # Already partitioned by the keys, so this aggregate moves nothing.
    document = parts.groupBy(*keys).agg(
        F.first(F.when(is_all, F.col("_overall")), ignorenulls=True).alias("_overall"),
        F.map_from_entries(F.collect_list(F.when(~is_all, F.struct("_scope", "_part")))).alias("_parts"),
    )
    named = {"model": model, "predictions_file": predictions_file}
    fields = [(F.lit(v) if isinstance(v, str) else v).alias(n) for n, v in named.items() if v is not None]
    fields.append(F.col("_overall.*"))
    if stratum:
        fields.append(F.col("_parts").alias(f"{stratum.removesuffix('_class')}_breakdown"))
    flat = document.select(*keys, *fields)
    body = F.struct(*[c for c in flat.columns if c not in keys])
    return flat.select(*keys, F.to_json(body).alias("summary"))


def run_summary(
    counts: DataFrame, labels: Sequence[str] = LETTERS, keys: Sequence[str] = (), **settings: str | int
) -> DataFrame:
    """``keys, summary`` of a logit-scoring run; ``settings`` (model, batch size, ...) are copied in."""
    report = classification_report(counts, labels, keys)
    per_label = [F.get("per_class", F.lit(i))["predicted"].alias(x) for i, x in enumerate(labels)]
    predicted = F.struct(*per_label, F.col("unknown_prediction_count").alias("UNKNOWN"))
    document = F.struct(
        "num_examples",
        "num_with_gold",
        F.col("accuracy_known").alias("accuracy"),
        "unknown_prediction_count",
        predicted.alias("prediction_counts"),
        *[F.lit(value).alias(name) for name, value in settings.items()],
    )
    return report.select(*keys, F.to_json(document).alias("summary"))


def correlation_summary(correlations: DataFrame, tests: DataFrame, rates: DataFrame) -> DataFrame:
    """The error analysis as rows of JSON: one per numeric feature, tested feature and feature value.

    A feature may have as many values as there are rows, so the document stays a table of lines.
    """

    def section(df: DataFrame, name: str, *fields: str) -> DataFrame:
        return df.select(F.lit(name).alias("section"), "feature", F.to_json(F.struct(*fields)).alias("entry"))

    return (
        section(correlations, "numerical_correlations", "correlation", "p_value")
        .unionByName(section(tests, "categorical_associations", "cramers_v", "p_value"))
        .unionByName(section(rates, "error_rates_by_category", "value", "error_rate", "support"))
    )


def leaves(documents: DataFrame, keys: Sequence[str] = (), column: str = "summary", depth: int = 5) -> DataFrame:
    """``keys, path, value``: every figure or text of JSON documents with its path, as text; objects nested up to ``depth`` deep."""
    rows = documents.select(*keys, F.lit("$").alias("path"), F.parse_json(column).alias("node"))
    object_map = F.from_json(F.to_json("node"), "map<string, variant>")
    is_object = F.startswith(F.schema_of_variant("node"), F.lit("OBJECT"))
    out = None
    for _ in range(depth + 1):
        found = rows.filter(~is_object).select(*keys, "path", F.variant_get("node", "$", "string").alias("value"))
        out = found if out is None else out.unionByName(found)
        inner = rows.filter(is_object).select(*keys, F.col("path").alias("_parent"), F.explode(object_map).alias("_name", "node"))
        rows = inner.select(*keys, F.concat("_parent", F.lit("."), "_name").alias("path"), "node")
    return out

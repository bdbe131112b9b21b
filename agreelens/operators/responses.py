"""Chat responses to predictions, and predictions to gold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import extract_label, item_id_from
from .joins import splittable_join
from .latest import checked_unique, last_rows

RESPONSE_SCHEMA = (
    "custom_id string, response struct<body: struct<choices: "
    "array<struct<message: struct<content: string, reasoning: string>>>>>"
)


def flatten_responses(df: DataFrame, on_bad: str = "unknown") -> DataFrame:
    """Add ``content`` and ``reasoning`` of the first choice and drop ``response``.

    ``on_bad="unknown"`` reads a missing text as empty; ``"fail"`` stops the job at such a row.
    """
    message = F.get("response.body.choices", 0)["message"]
    content = message["content"]
    if on_bad == "fail":
        missing = F.concat(F.lit("response without content: "), F.coalesce("custom_id", F.lit("?")))
        content = F.coalesce(content, F.raise_error(missing).cast("string"))
    elif on_bad != "unknown":
        raise ValueError(f"unknown on_bad {on_bad!r}")
    return (
        df.withColumn("content", F.coalesce(content, F.lit("")))
        .withColumn("reasoning", F.coalesce(message["reasoning"], F.lit("")))
        .drop("response")
    )


def predictions(df: DataFrame, mode: str = "letter") -> DataFrame:
    """Add ``item_id`` from ``custom_id`` and ``predicted_label`` from ``content``."""
    return df.withColumn("item_id", item_id_from(F.coalesce("custom_id", F.lit("")))).withColumn(
        "predicted_label", extract_label(F.col("content"), mode)
    )


def dedupe_gold(gold: DataFrame, key: str = "item_id", order: Sequence[str] = ("row_id",)) -> DataFrame:
    """One row per key, the last by ``order`` (``latest.last_rows``)."""
    return last_rows(gold, [key], order).select(key, *[F.col(f"`{c}`") for c in gold.columns if c != key])


def match_gold(
    preds: DataFrame,
    gold: DataFrame,
    on: str = "item_id",
    salts: int = 1,
    order: Sequence[str] | None = None,
    unique: bool = False,
    hot: Sequence[str] | None = None,
) -> DataFrame:
    """Inner join; predictions without gold drop out and repeated predictions all stay.

    With ``order``, the last gold row of an id by these columns counts. Without it a repeated id in ``gold`` stops the job;
    ``unique`` promises that there is none, as after an aggregation by id, and spares the check. ``salts`` and ``hot`` are those of ``splittable_join``.
    """
    if order:
        gold = dedupe_gold(gold, on, order)
    elif not unique:
        gold = checked_unique(gold, on, "gold")
    return splittable_join(preds, gold, [on], "inner", salts, hot)


def unmatched(preds: DataFrame, gold: DataFrame, on: str = "item_id") -> DataFrame:
    """Predictions the evaluation drops for want of gold, as a data-quality output."""
    return splittable_join(preds, gold.select(on), [on], "left_anti")


def detailed_records(
    preds: DataFrame,
    gold: DataFrame,
    on: str = "item_id",
    salts: int = 1,
    order: Sequence[str] | None = None,
    unique: bool = False,
) -> DataFrame:
    """One record per matched prediction: labels, texts and every item column. ``order`` and ``unique`` as in ``match_gold``."""
    item_columns = [c for c in gold.columns if c not in (on, "gold_label", "entropy_class")]
    joined = match_gold(preds, gold, on, salts, order, unique)
    return joined.select(
        "custom_id",
        "predicted_label",
        "gold_label",
        is_correct(F.col("predicted_label"), F.col("gold_label")).alias("is_correct"),
        "entropy_class",
        F.col("content").alias("raw_model_response"),
        F.col("reasoning").alias("model_reasoning"),
        *[F.col(f"`{c}`") for c in item_columns],
    )


def is_correct(pred: Column, gold: Column) -> Column:
    """False, not NULL, when either side is missing."""
    return F.coalesce(pred == gold, F.lit(False))

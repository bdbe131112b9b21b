"""Live evaluation: response files arrive, confusion counts stay current."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.joins import hot_keys
from ..operators.metrics import confusion_counts
from ..operators.responses import RESPONSE_SCHEMA, flatten_responses, match_gold, predictions
from . import deltas


def response_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """New response files below ``path`` as a stream."""
    reader = spark.readStream.schema(RESPONSE_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def batch_counts(
    responses: DataFrame,
    gold: DataFrame,
    mode: str = "letter",
    keys: Sequence[str] = (),
    hot_share: float = 0.01,
    salts: int = 32,
) -> DataFrame:
    """Confusion counts of one micro-batch against gold, whose ids are unique.

    A heavy-hitter sketch over the batch's item ids, merged from all its partitions, names the items that may own ``hot_share`` of the rows. There are
    at most ``1 / hot_share`` of them; their rows are spread over ``salts`` partitions, and gold is copied for them alone.
    """
    preds = predictions(flatten_responses(responses), mode).select(*keys, "item_id", "predicted_label")
    labelled = gold.select("item_id", *[c for c in ("gold_label", "entropy_class") if c in gold.columns])
    hot = hot_keys(preds, "item_id", hot_share)
    return confusion_counts(match_gold(preds, labelled, salts=salts if hot else 1, unique=True, hot=hot), keys=keys)


def run_confusion(
    responses: DataFrame,
    gold: DataFrame,
    path: str,
    checkpoint: str,
    mode: str = "letter",
    keys: Sequence[str] = (),
    hot_share: float = 0.01,
    available_now: bool = True,
) -> StreamingQuery:
    """Keep confusion counts against a static gold table current below ``path``.

    Every trigger writes the counts of its own rows as a delta under its batch number and overwrites it when replayed, so a
    restart after a lost driver neither loses nor doubles a count. Counts add up, so the stream itself holds no state. Pass ``gold`` staged:
    every trigger reads it.
    """
    return deltas.run_deltas(
        responses, path, checkpoint, each=lambda batch: batch_counts(batch, gold, mode, keys, hot_share), available_now=available_now
    )


def summed(rows: DataFrame) -> DataFrame:
    by = [c for c in rows.columns if c not in ("n", "batch_id")]
    return rows.groupBy(*by).agg(F.sum("n").alias("n"))


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """The counts as of the last finished trigger."""
    return deltas.read_table(spark, path, summed)


def compact(spark: SparkSession, path: str) -> str | None:
    """Fold the counts so far into a base."""
    return deltas.compact(spark, path, summed)

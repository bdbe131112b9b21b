"""Live annotation state: log rows arrive, the state per annotator and sample stays current."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.annotation import STATE_KEYS, state_aggregates, unpack_state
from . import deltas


def stream_state(log: DataFrame, order: Sequence[str] = ("ts",), keys: Sequence[str] = STATE_KEYS) -> DataFrame:
    """The batch fold as a streaming aggregate: state is the last save and the first skip per key.

    Both depend on the order column only, so rows may arrive late or in any order.
    """
    return unpack_state(log.groupBy(*keys).agg(*state_aggregates(order)), keys)


def newest_versions(keys: Sequence[str] = STATE_KEYS) -> deltas.Fold:
    """Of every key the version of the last batch that changed it."""

    def fold(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
        newest = F.max_by(F.struct(*rest), "batch_id").alias("_newest")
        return rows.groupBy(*keys).agg(newest).select(*keys, "_newest.*")

    return fold


def run_to_table(state: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write the keys each trigger changed as its delta; the full state is never rewritten by the stream."""
    return deltas.run_deltas(state, path, checkpoint, mode="update", available_now=available_now)


def current_state(spark: SparkSession, path: str, keys: Sequence[str] = STATE_KEYS) -> DataFrame:
    """The newest version of every key."""
    return deltas.read_table(spark, path, newest_versions(keys))


def compact(spark: SparkSession, path: str, keys: Sequence[str] = STATE_KEYS) -> str | None:
    """Fold the state so far into a base. The stream goes on as before, and readers take base and later deltas."""
    return deltas.compact(spark, path, newest_versions(keys))

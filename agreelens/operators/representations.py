"""Layer representations joined to labels and groups, without moving the representations.

They are the largest table of a probe study: items times layers times vector width. So they are written once, bucketed by item, as the model
emits them; every later join with a table of items shuffles that table alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from .latest import checked_unique


def stage_representations(reps: DataFrame, table: str, buckets: int, on: str = "item_id", path: str | None = None) -> DataFrame:
    """Write ``reps`` as a table with ``buckets`` buckets by item, and return it.

    ``path`` is a folder that all executors share (a new one below the shared folder by default). Choose ``buckets`` so that a bucket fits a task: at 100 TB some ten thousand. Rows are first dealt out by the same hash, so
    that each bucket is one file and not one per task. An item that owns many rows (layers, repeats) makes its bucket larger, which the scan splits again.
    """
    spark = reps.sparkSession
    dealt = reps.repartition(buckets, on)
    writer = dealt.write.bucketBy(buckets, on).format("parquet").mode("errorifexists")
    writer.option("path", path or shared_dir(spark, "representations")).saveAsTable(table)
    return spark.table(table)


def labelled_representations(
    spark: SparkSession, table: str, items: DataFrame, columns: Sequence[str] = ("label", "group"), on: str = "item_id", unique: bool = False
) -> DataFrame:
    """Rows of a table of ``stage_representations`` with the items' ``columns``; rows without an item drop out.

    ``items`` is shuffled into the table's buckets, or broadcast if the adaptive planner measures it to be small; the representations are read
    where they lie. A repeated item stops the job unless ``unique`` promises that there is none.
    """
    rows = spark.table(table)
    clash = sorted(set(rows.columns) & set(columns))
    if clash:
        raise ValueError(f"columns on both sides: {clash}")
    items = items if unique else checked_unique(items, on, "the item table")
    # One type on both sides: a cast of the bucketed column would cost its buckets.
    side = items.select(F.col(f"`{on}`").cast(rows.schema[on].dataType).alias(on), *[F.col(f"`{c}`") for c in columns])
    return rows.join(side, on)

"""Row numbers without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir


def with_row_index(df: DataFrame, order: Sequence[str | Column], name: str = "row_id") -> DataFrame:
    """Add 0-based positions in the total order given by ``order``.

    The rows are range-sorted and written to the shared work folder with their task and their place in it, both
    of which ``monotonically_increasing_id`` holds. A row's position is that place plus the number of rows of
    earlier tasks; that list is as long as the sort has tasks. How many files a task writes does not matter.
    Numbers are fixed once written, however often the result is read or recomputed, and no row passes through
    Python or through a single task, as it would in a window without partition key.
    """
    spark = df.sparkSession
    path = shared_dir(spark, "row-index")
    placed = df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id())
    placed.write.parquet(path)
    # An explicit schema spares a look at the files, and an empty result leaves none.
    staged = spark.read.schema(placed.schema).parquet(path)
    task = F.shiftright("_place", 33)
    tasks = staged.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tasks.select("_task", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    position = (F.col("_offset") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).alias(name)
    columns = [F.col(f"`{c}`") for c in df.columns]
    return staged.withColumn("_task", task).join(F.broadcast(offsets), "_task").select(*columns, position)


def with_file_order(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Row positions in file order, for tables read straight from files.

    Spark packs file splits by size, not by name, so the order is spelled out: file, split offset, position
    within the split.
    """
    ordered = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_pos"),
    )
    return with_row_index(ordered, ["_file", "_start", "_pos"], name).drop("_file", "_start", "_pos")


def first_rows(df: DataFrame, n: int | None, order: Sequence[str], in_one_task: int = 100_000) -> DataFrame:
    """The first n rows by ``order`` (all when n is None); of rows equal in ``order`` which ones is open.

    Up to ``in_one_task`` rows each task keeps its first n, and one merges them. More are selected where they lie: rows are dealt into
    ranges of ``order`` and written, the ranges are counted, those wholly among the first n are taken as they are, and only the range that holds the n-th row
    is cut. So no task sees more than a range, and nothing is sorted but that one.
    """
    if n is None or n <= in_one_task:
        return df if n is None else df.orderBy(*order).limit(n)
    spark, path = df.sparkSession, shared_dir(df.sparkSession, "first-rows")
    # Given by number, ranges are not put together again for being small.
    ranges = min(20_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * n // max(1, in_one_task)))
    # Ties beyond the order must not make one range: the place among all rows breaks them.
    placed = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *order, "_tie")
    ranged = placed.withColumn("_range", F.spark_partition_id())
    ranged.write.parquet(path)
    staged = spark.read.schema(ranged.schema).parquet(path)
    # One row per task of the shuffle.
    before, last, rest = 0, -1, 0
    for r in sorted(staged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()):
        if before + r["n"] > n:
            last, rest = r["_range"], n - before
            break
        before, last = before + r["n"], r["_range"] + 1
    whole = staged.filter(F.col("_range") < last)
    cut = staged.filter(F.col("_range") == last).orderBy(*order, "_tie").limit(rest)
    return (whole.unionByName(cut) if rest else whole).select(*[F.col(f"`{c}`") for c in df.columns])

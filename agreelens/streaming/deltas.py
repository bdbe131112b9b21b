"""A table that a stream keeps current: a base and, after it, one delta per micro-batch.

``<path>/deltas/batch_id=<n>`` holds what batch n added, and is overwritten if the batch is replayed. ``<path>/base/<name>`` holds a compaction, and
``<path>/commits`` a row for each base with the last batch it contains. Readers take the newest committed base and
the deltas after it. A compaction that dies before its commit row is written leaves an unread folder; one that is repeated commits the
same content under another name; a batch that is replayed after a base contains it is not read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

COMMIT = "base string, through bigint, written timestamp"

#: Combines rows of base and deltas into the table; ``batch_id`` tells the newer ones.
Fold = Callable[[DataFrame], DataFrame]


def write_delta(batch: DataFrame, path: str, batch_id: int) -> None:
    batch.write.mode("overwrite").parquet(f"{path}/deltas/batch_id={batch_id}")


def run_deltas(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", each: Fold | None = None, available_now: bool = True) -> StreamingQuery:
    """Write what each trigger brings, after ``each`` if given, as a delta."""

    def save(batch: DataFrame, batch_id: int) -> None:
        write_delta(batch if each is None else each(batch), path, batch_id)

    writer = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _finished(spark: SparkSession, path: str) -> list[int]:
    """Batches whose delta is wholly written, by Spark's own marker: a trigger in flight, or one that died, has none."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/deltas/batch_id=*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(s.getPath().getParent().getName().removeprefix("batch_id=")) for s in found or ())


def last_commit(spark: SparkSession, path: str) -> tuple[str, int] | None:
    """The newest base and the last batch in it. Commits are one row per compaction."""
    try:
        commits = spark.read.schema(COMMIT).parquet(f"{path}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    row = commits.orderBy(F.desc("through"), F.desc("written"), "base").head()
    return None if row is None else (row["base"], row["through"])


def _parts(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame | None, int]:
    """Base rows, as of their last batch, the finished deltas after it, and the last batch of all."""
    commit = last_commit(spark, path)
    through = -1 if commit is None else commit[1]
    base = None if commit is None else spark.read.parquet(f"{path}/base/{commit[0]}").withColumn("batch_id", F.lit(through))
    later = [n for n in _finished(spark, path) if n > through]
    if not later:
        return base, None, through
    deltas = spark.read.option("basePath", f"{path}/deltas").parquet(*[f"{path}/deltas/batch_id={n}" for n in later])
    return base, deltas.withColumn("batch_id", F.col("batch_id").cast("bigint")), later[-1]


def read_table(spark: SparkSession, path: str, fold: Fold) -> DataFrame:
    """The table as of the last finished trigger."""
    base, deltas, _ = _parts(spark, path)
    rows = deltas if base is None else base if deltas is None else base.unionByName(deltas)
    if rows is None:
        raise ValueError(f"no batch has been written below {path}")
    return fold(rows)


def compact(spark: SparkSession, path: str, fold: Fold) -> str | None:
    """Fold base and deltas into a new base; returns its name, or None if there was nothing to fold.

    May run beside the stream: only finished deltas are folded, and the commit names the last of them.
    """
    base, deltas, through = _parts(spark, path)
    if deltas is None:
        return None
    name = uuid.uuid4().hex
    fold(deltas if base is None else base.unionByName(deltas)).write.parquet(f"{path}/base/{name}")
    row = spark.range(1).select(F.lit(name).alias("base"), F.lit(through).cast("bigint").alias("through"), F.current_timestamp().alias("written"))
    # One row in one file: its rename is the commit.
    row.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return name


def retired(spark: SparkSession, path: str) -> list[str]:
    """Folders that no reader needs any more: bases before the newest, and the deltas it contains. Deleting them is the caller's choice of time."""
    commit = last_commit(spark, path)
    if commit is None:
        return []
    bases = spark.read.schema(COMMIT).parquet(f"{path}/commits").filter(F.col("base") != commit[0]).select("base").distinct().collect()
    old = [n for n in _finished(spark, path) if n <= commit[1]]
    return [f"{path}/base/{r['base']}" for r in bases] + [f"{path}/deltas/batch_id={n}" for n in old]

"""Writers. Partitioned folders throughout: every task writes its own part file."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed_point


def write_csv(df: DataFrame, path: str, decimals: Mapping[str, int] | None = None, mode: str = "errorifexists") -> None:
    """CSV with header; ``decimals`` gives columns a fixed number of digits."""
    for name, digits in (decimals or {}).items():
        df = df.withColumn(name, fixed_point(F.col(f"`{name}`"), digits))
    writer = df.write.mode(mode).option("header", True).option("escape", '"')
    # Blanks at the ends of a field are data.
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_json_lines(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    """One object per line, NULL fields included; ``partition_by`` columns become folders."""
    writer = df.write.mode(mode).option("ignoreNullFields", False)
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def write_json_objects(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Indented objects one after another, as ``json_stream.read_json_objects`` reads them."""
    text = F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"})
    df.select(text.alias("value")).write.mode(mode).text(path)


def write_json_arrays(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Part files that are each one valid JSON array; rows stream through, nothing is gathered.

    Texts stay in Arrow's buffers, whose size Spark bounds: as Python strings a batch would be there in several copies, and
    a single wide character makes a text four times as large.
    """

    def as_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener, kind = "[", pa.string()
        for batch in batches:
            kind = batch.schema.field(0).type
            for start in range(0, batch.num_rows, 100):
                rows = batch.column(0).slice(start, 100)
                before = pa.array([opener] + [","] * (len(rows) - 1), kind)
                yield pa.record_batch([pc.binary_join_element_wise(before, rows, pa.scalar("", kind))], ["value"])
                opener = ","
            # Not kept while the next one is read.
            batch = rows = None
        yield pa.record_batch([pa.array(["]" if opener == "," else "[]"], kind)], ["value"])

    text = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    df.select(text.alias("value")).mapInArrow(as_array, "value string").write.mode(mode).text(path)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], mode: str = "errorifexists") -> None:
    """Parquet with one folder per key set (model, split, run, annotator), read back with partition pruning.

    Rebalancing first keeps the file count near the data size: each key set is gathered, and split again
    where it is large.
    """
    df.hint("rebalance", *by).write.mode(mode).partitionBy(*by).parquet(path)

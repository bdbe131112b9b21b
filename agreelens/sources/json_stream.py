"""Files of JSON objects written one after another, indented over several lines."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"
_ON_BAD = ("null", "drop", "fail", "stop")
# Between objects only: no control character may stand in JSON text, and Python's decoder takes this one for a blank.
_BETWEEN = "\x1e"
# What Python's decoder takes, too.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def read_json_objects(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str,
    style: str = "indented",
    on_bad: str = "null",
) -> DataFrame:
    """Objects as rows, with ``_corrupt_record`` holding the text of damaged ones.

    ``style="indented"``: every object closes with a brace in the first column, as pretty-printing writers
    produce. That line is used as the record separator, so large files are split between tasks. A chunk that is not exactly
    one object (one-line objects, Windows line ends, mixed or damaged files) is decoded object by object, so none is
    lost; such a file is one chunk, and so one task, where it has no separator. Objects that start on lines of their own
    are told apart by Spark; Python decodes the chunks with damage or with several objects on a line, a hundred at a time.
    ``style="any"``: objects on one line or many, with any spacing; each file is decoded by one task.

    ``on_bad``: "null" keeps a damaged object as a row of NULLs, "drop" leaves it out, "fail" stops the job,
    "stop" drops it and everything after it in the same file.
    """
    if on_bad not in _ON_BAD:
        raise ValueError(f"unknown on_bad {on_bad!r}, expected one of {_ON_BAD}")
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if style == "indented":
        raw = _split_indented(spark, path, schema)
    elif style == "any":
        raw = _decode_files(spark, path)
    else:
        raise ValueError(f"unknown style {style!r}")
    if on_bad == "stop":
        raw = _until_damage(raw, schema)
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"columnNameOfCorruptRecord": CORRUPT}
    parsed = raw.select(F.from_json("_json", full, options).alias("_o")).select("_o.*")
    if on_bad == "fail":
        damaged = F.raise_error(F.concat(F.lit("damaged JSON object: "), F.col(CORRUPT))).cast("string")
        return parsed.withColumn(CORRUPT, F.when(F.col(CORRUPT).isNotNull(), damaged))
    return parsed.filter(F.col(CORRUPT).isNull()) if on_bad == "drop" else parsed


def _split_indented(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    text = spark.read.option("lineSep", "\n}\n").text(path)
    value = F.rtrim("value", F.lit(" \t\r\n"))
    # The separator took the closing brace away, except from a last object without a final newline.
    closed = F.when(F.endswith(value, F.lit("\n}")), value).otherwise(F.concat(value, F.lit("\n}")))
    chunks = text.filter(value != "").select(
        closed.alias("_json"),
        value.alias("_value"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_pos"),
    )
    # Inside brackets a second object is a parse error instead of being passed over.
    alone = F.from_json(F.concat(F.lit("["), F.col("_json"), F.lit("]")), T.ArrayType(schema))
    flagged = chunks.withColumn("_single", F.coalesce(F.size(alone) == 1, F.lit(False)))
    # The separator took a brace or it did not: at most one of the readings is whole.
    lines = F.coalesce(_on_own_lines(F.col("_json")), _on_own_lines(F.col("_value")))
    split = flagged.withColumn("_lines", F.when(F.col("_single"), F.array("_json")).otherwise(lines))
    # One pass: only chunks that are still whole reach the decoder, as the others go there as NULL.
    pieces = F.coalesce("_lines", _decoded(F.when(F.col("_lines").isNull(), F.col("_value"))))
    return split.select(F.posexplode(pieces).alias("_sub", "_json"), "_file", "_start", "_pos")


def _on_own_lines(text: Column) -> Column:
    """The objects of a text, if each starts a line of its own and all are undamaged; else NULL."""

    def objects(*parts: Column | str) -> Column:
        array = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        return F.size(F.from_json(array, T.ArrayType(T.StructType()), _STRICT))

    def whole(piece: Column) -> Column:
        # Exactly one: a closing bracket of its own would hide what follows it, the second object included.
        exact = (objects("[", piece, "]") == 1) & (objects("[", piece, ",{}]") == 2)
        bare = F.startswith(piece, F.lit("{")) & F.endswith(piece, F.lit("}"))
        return F.coalesce(bare & exact, F.lit(False))

    for line_end in ("\r\n", "\n"):
        text = F.replace(text, F.lit(line_end + "{"), F.lit(_BETWEEN + "{"))
    # In an array of one, the pieces are made once for the test and the result.
    return F.get(F.filter(F.array(F.split(text, _BETWEEN)), lambda pieces: F.forall(pieces, whole)), F.lit(0))


def _objects(text: str) -> Iterator[tuple[str, bool]]:
    """The objects of a text, one after the other; what cannot be read is handed on as one last piece, marked False."""
    decoder, at = json.JSONDecoder(), 0
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if at >= len(text):
            return
        try:
            _, end = decoder.raw_decode(text, at)
        except ValueError:
            # Nothing after the damage can be told apart.
            yield text[at:], False
            return
        yield text[at:end], True
        at = end


@F.udf(T.ArrayType(T.StringType()), useArrow=False)
def _decoded(value: str | None) -> list[str] | None:
    """Objects of a chunk. Whether the separator took a brace from it cannot be seen; the reading without damage is right.

    Not by Arrow: its batches hold thousands of chunks, and several copies of them in Python.
    """
    if value is None:
        return None
    found = list(_objects(value))
    if not all(ok for _, ok in found):
        found = _objects(value if value.endswith("\n}") else value + "\n}")
    return [o for o, _ in found]


def _decode_files(spark: SparkSession, path) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("_file"))

    def objects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, file in zip(batch["value"], batch["_file"]):
                numbered = enumerate(o for o, _ in _objects(text))
                while rows := list(islice(numbered, 10_000)):
                    place, found = zip(*rows)
                    yield pd.DataFrame({"_sub": place, "_json": found, "_file": file, "_start": 0, "_pos": 0})

    return files.mapInPandas(objects, "_sub int, _json string, _file string, _start bigint, _pos bigint")


def _until_damage(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows before the first damaged object of their file; the join side has one row per damaged file."""
    probe = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json("_json", probe, {"columnNameOfCorruptRecord": CORRUPT})
    place = F.struct("_start", "_pos", "_sub")
    first = (
        raw.filter(parsed[CORRUPT].isNotNull()).groupBy("_file").agg(F.min(place).alias("_first_bad"))
    )
    return raw.join(first, "_file", "left").filter(
        F.col("_first_bad").isNull() | (place < F.col("_first_bad"))
    )

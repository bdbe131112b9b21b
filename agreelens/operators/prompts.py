"""Prompt texts and chat request records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import PREDICTION_FLAG, PROMPT_INTRO
from ..functions.text import nonblank, path_safe, py_strip


def prompt_text(context: Column, statement: Column) -> Column:
    """Plain concatenation: a ``%`` or a brace in the data is never taken for a placeholder."""
    return F.concat(
        F.lit(PROMPT_INTRO + "[CONTEXT]: "),
        context,
        F.lit("\n[HYPOTHESIS]: "),
        statement,
        F.lit("\n\n" + PREDICTION_FLAG),
    )


def add_prompt(df: DataFrame, premise: str = "premise", hypothesis: str = "hypothesis") -> DataFrame:
    """Add ``llm_prompt`` with trimmed inputs and a final newline."""
    text = prompt_text(py_strip(F.col(premise)), py_strip(F.col(hypothesis)))
    return df.withColumn("llm_prompt", F.concat(text, F.lit("\n")))


def join_premise(df: DataFrame, left: str, right: str, out: str = "premise", separator: str = " ") -> DataFrame:
    """Concatenate two text columns, e.g. with ``' [SEP] '``; NULL when either is NULL."""
    return df.withColumn(out, F.concat(F.col(left), F.lit(separator), F.col(right)))


def chat_requests(
    df: DataFrame,
    model: str,
    temperature: float = 0.0,
    reasoning: bool = False,
    max_tokens: int = 100,
    run: int = 1,
    row_id: str = "row_id",
    premise: str = "premise",
    hypothesis: str = "hypothesis",
) -> DataFrame:
    """Replace premise and hypothesis by ``custom_id`` and a nested ``body``; blank premises are skipped.

    Other columns (for instance a label computed for reference) stay and can be dropped at the sink.
    """
    message = F.struct(
        F.lit("user").alias("role"), prompt_text(F.col(premise), F.col(hypothesis)).alias("content")
    )
    body = F.struct(
        F.lit(model).alias("model"),
        F.array(message).alias("messages"),
        F.lit(max_tokens).alias("max_tokens"),
        F.struct(F.lit(reasoning).alias("enabled")).alias("reasoning"),
        F.lit(float(temperature)).alias("temperature"),
    )
    custom_id = F.concat(F.lit("id"), F.col(row_id).cast("string"), F.lit(f"_run{run}"))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (premise, hypothesis)]
    return df.filter(nonblank(F.col(premise))).select(custom_id.alias("custom_id"), body.alias("body"), *rest)


def prompt_input(df: DataFrame, column: str = "llm_prompt") -> DataFrame:
    """The prompt a scorer sees: text, empty when missing, trimmed."""
    return df.withColumn(column, py_strip(F.coalesce(F.col(column).cast("string"), F.lit(""))))


def request_name(model: Column, temperature: Column, reasoning: Column) -> Column:
    """Output name for a request set, to be used as a partition value."""
    return F.concat(
        F.lit("nli_prompt_"),
        path_safe(model),
        F.lit("_temp"),
        temperature.cast("string"),
        F.when(reasoning, F.lit("_reasoning")).otherwise(F.lit("_no_reasoning")),
    )

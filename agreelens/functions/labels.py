"""Model text and gold codes to labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import LEGACY_CODES, PREDICTION_FLAG, PREFERRED_CODES, UNKNOWN
from .text import literal_map, py_strip


def _first_contained(text: Column, choices: list[tuple[str, str]]) -> Column:
    out = F.lit(UNKNOWN)
    for needle, label in reversed(choices):
        out = F.when(F.contains(text, F.lit(needle)), F.lit(label)).otherwise(out)
    return F.coalesce(out, F.lit(UNKNOWN))


def extract_label(text: Column, mode: str = "word") -> Column:
    """The label a response names.

    ``word``: a full label word anywhere. ``letter``: the letter e, then c, then n anywhere, so that
    "neutral" reads as entailment. ``letter_after_marker``: the same letters, looked for only after the
    last prediction flag when the text has one: an echoed prompt holds the flag itself.
    """
    lowered = F.lower(text)
    if mode == "word":
        return _first_contained(
            lowered,
            [("entailment", "entailment"), ("contradiction", "contradiction"), ("neutral", "neutral")],
        )
    if mode == "letter_after_marker":
        flag = PREDICTION_FLAG.lower()
        lowered = F.split_part(lowered, F.lit(flag), F.lit(-1))
    elif mode != "letter":
        raise ValueError(f"unknown extraction mode {mode!r}")
    return _first_contained(lowered, [("e", "entailment"), ("c", "contradiction"), ("n", "neutral")])


def item_id_from(custom_id: Column) -> Column:
    """Digits of the first ``id<digits>``, else the whole id."""
    # regexp_extract gives '' for no match.
    return F.coalesce(F.nullif(F.regexp_extract(custom_id, r"id([0-9]+)", 1), F.lit("")), custom_id)


def code_to_letter(code: Column, legacy: Column) -> Column:
    """Integer code to letter: the chosen convention first, then the newer, then the older one."""
    older, newer = literal_map(LEGACY_CODES), literal_map(PREFERRED_CODES)
    # A code beyond the range of int is no label.
    code = code.try_cast("int")
    chosen = F.when(legacy, F.try_element_at(older, code)).otherwise(F.try_element_at(newer, code))
    return F.coalesce(chosen, F.try_element_at(newer, code), F.try_element_at(older, code))


def text_to_letter(text: Column, legacy: Column) -> Column:
    """Gold text to letter: letters, label prefixes, or a string of digits."""
    t = F.lower(py_strip(text))
    digits = F.when(t.rlike(r"^[0-9]+$"), t.try_cast("int"))
    return (
        F.when(t.isin("e", "n", "c"), F.upper(t))
        .when(F.startswith(t, F.lit("entail")), F.lit("E"))
        .when(F.startswith(t, F.lit("neut")), F.lit("N"))
        .when(F.startswith(t, F.lit("contra")), F.lit("C"))
        .otherwise(code_to_letter(digits, legacy))
    )


def normalize_gold(value: Column, kind: str, legacy: Column | bool = False) -> Column:
    """Gold value of any source type to E, N, C or NULL.

    ``kind`` is the Spark type name of the column. A ``variant`` column (a JSON field that holds numbers
    in one row and text in the next) is decided row by row. Booleans and fractions have no label.
    """
    legacy = F.lit(legacy) if isinstance(legacy, bool) else legacy
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return code_to_letter(value, legacy)
    if kind == "string":
        return text_to_letter(value, legacy)
    if kind == "variant":
        stored = F.schema_of_variant(value)
        return F.when(
            stored == "BIGINT", code_to_letter(F.try_variant_get(value, "$", "int"), legacy)
        ).when(stored == "STRING", text_to_letter(F.try_variant_get(value, "$", "string"), legacy))
    return F.lit(None).cast("string")


def error_type(gold: Column, pred: Column) -> Column:
    """``Gold:XXX -> Pred:YYY`` with three-letter upper-case stems."""
    return F.concat(
        F.lit("Gold:"), F.upper(F.substring(gold, 1, 3)), F.lit(" -> Pred:"), F.upper(F.substring(pred, 1, 3))
    )

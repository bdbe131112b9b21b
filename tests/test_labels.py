import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from agreelens.functions import labels as L
from agreelens.functions import text as TX
from agreelens.functions.constants import PY_WHITESPACE


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "mode, expected",
    [
        ("letter", ["entailment", "entailment", "contradiction", "neutral", "unknown", "entailment", "unknown", "entailment"]),
        ("word", ["entailment", "neutral", "contradiction", "unknown", "unknown", "entailment", "unknown", "unknown"]),
        (
            "letter_after_marker",
            ["entailment", "entailment", "contradiction", "neutral", "unknown", "entailment", "unknown", "contradiction"],
        ),
    ],
)
def test_extractors(spark, mode, expected):
    texts = ["Entailment", "NEUTRAL", "Contradiction", "N", "", "neutral entailment", None, "e [PREDICTION]: C"]
    assert column(spark, texts, lambda c: L.extract_label(c, mode)) == expected


@pytest.mark.parametrize("answer, label", [("E", "entailment"), ("n", "neutral"), ("C", "contradiction"), ("?", "unknown"), ("", "unknown")])
def test_answer_after_echoed_prompt(spark, answer, label):
    text = "Give one label after the flag '[PREDICTION]:'.\n\n[CONTEXT]: ice\n[PREDICTION]: " + answer
    assert column(spark, [text], lambda c: L.extract_label(c, "letter_after_marker")) == [label]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
def test_extractors_are_total(spark, texts):
    texts = [t.replace("\x00", "").encode("utf-8", "ignore").decode() for t in texts]
    allowed = {"entailment", "neutral", "contradiction", "unknown"}
    for mode in ("letter", "word", "letter_after_marker"):
        assert set(column(spark, texts, lambda c, m=mode: L.extract_label(c, m))) <= allowed


def test_item_ids(spark):
    got = column(spark, ["id12_run1", "x-id7", "id", "abc", "", "id1id2"], L.item_id_from)
    assert got == ["12", "7", "id", "abc", "", "1"]


def test_gold_text(spark):
    values = ["E", " Entailment ", "neutral", "contradict", "NEUT", "0", "1", "2", "3", "-1", "0.0", "", None, "\nc\n", "02"]
    legacy = column(spark, values, lambda c: L.normalize_gold(c, "string", True))
    preferred = column(spark, values, lambda c: L.normalize_gold(c, "string", False))
    assert preferred == ["E", "E", "N", "C", "N", "E", "C", "N", None, None, None, None, None, "C", "N"]
    assert legacy == ["E", "E", "N", "C", "N", "N", "C", "N", None, None, None, None, None, "C", "N"]


def test_gold_codes(spark):
    values = [-1, 0, 1, 2, 3, None]
    assert column(spark, values, lambda c: L.normalize_gold(c, "int", True), "int") == ["E", "N", "C", "N", None, None]
    assert column(spark, values, lambda c: L.normalize_gold(c, "bigint", False), "bigint") == [
        "E", "E", "C", "N", None, None,
    ]


def test_gold_other_types(spark):
    assert column(spark, [True, False], lambda c: L.normalize_gold(c, "boolean"), "boolean") == [None, None]
    assert column(spark, [0.0], lambda c: L.normalize_gold(c, "double"), "double") == [None]
    mixed = ["1", '"1"', "-1", '"-1"', "true", "null", "0.0", '" Entail"']
    parsed = lambda c: L.normalize_gold(F.parse_json(c), "variant", False)
    assert column(spark, mixed, parsed) == ["C", "C", "E", None, None, None, None, "E"]


def test_strip_matches_python(spark):
    values = [w + "a b" + w for w in PY_WHITESPACE] + ["", " \n", "a"]
    assert column(spark, values, TX.py_strip) == [v.strip() for v in values]


def test_error_type(spark):
    df = spark.createDataFrame([("neutral", "unknown")], "g string, p string")
    assert df.select(L.error_type(F.col("g"), F.col("p"))).head()[0] == "Gold:NEU -> Pred:UNK"


def test_fixed_point_and_path(spark):
    df = spark.createDataFrame([(2 / 3, "org/name")], "x double, m string")
    row = df.select(TX.fixed_point(F.col("x"), 6), TX.path_safe(F.col("m"))).head()
    assert list(row) == ["0.666667", "org_name"]


def test_code_beyond_int_is_no_label(spark):
    df = spark.createDataFrame([(3_000_000_000,), (1,)], "code bigint")
    got = [r[0] for r in df.select(L.code_to_letter(F.col("code"), F.lit(False))).collect()]
    assert got[0] is None and got[1] is not None

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from agreelens.operators import metrics as M
from agreelens.operators import summary as SU

LETTERS = ["E", "N", "C"]
G1 = [[93, 0, 20], [2, 4, 10], [2, 0, 119]]
G2 = [[24, 46, 36], [16, 39, 26], [15, 33, 15]]


def counts_of(spark, matrix, labels=LETTERS):
    rows = [(g, p, n) for g, row in zip(labels, matrix) for p, n in zip(labels, row)]
    return spark.createDataFrame(rows, "gold string, pred string, n bigint")


def rows_of(spark, pairs, schema="gold_label string, predicted_label string"):
    return spark.createDataFrame(pairs, schema)


@pytest.mark.parametrize(
    "matrix, accuracy, macro, weighted, f1, support, predicted",
    [
        (
            G1, 0.864, 0.7223985890652558, 0.8525798941798941,
            [0.8857142857142857, 0.4, 0.8814814814814815], [113, 16, 121], [97, 4, 149],
        ),
        (
            G2, 0.312, 0.30146071974780736, 0.30740491276257065,
            [0.2981366459627329, 0.3919597989949749, 0.21428571428571427], [106, 81, 63], [55, 118, 77],
        ),
    ],
)
def test_goldens(spark, matrix, accuracy, macro, weighted, f1, support, predicted):
    row = M.classification_report(counts_of(spark, matrix), LETTERS).head()
    assert row["num_examples"] == 250
    assert row["accuracy_all"] == row["accuracy_known"] == row["micro_f1"] == accuracy
    # Plain summation may differ from compensated summation in the last bit.
    assert row["macro_f1"] == pytest.approx(macro, rel=1e-15)
    assert row["weighted_f1"] == pytest.approx(weighted, rel=1e-15)
    assert [c["f1"] for c in row["per_class"]] == f1
    assert [c["support"] for c in row["per_class"]] == support
    assert [c["predicted"] for c in row["per_class"]] == predicted


def test_golden_prediction_counts(spark):
    rows = M.prediction_counts(counts_of(spark, G2), LETTERS).collect()
    assert [(r["label"], r["n"]) for r in rows] == [("E", 55), ("N", 118), ("C", 77), ("UNKNOWN", 0)]


def test_null_gold_rules(spark):
    df = rows_of(spark, [("E", "E"), (None, "E"), (None, None), ("N", "E")])
    row = M.classification_report(M.confusion_counts(df), LETTERS).head()
    assert row["accuracy_known"] == 0.5
    assert row["accuracy_all"] == 0.5
    assert (row["num_with_gold"], row["unknown_prediction_count"]) == (2, 1)
    e = row["per_class"][0]
    assert (e["tp"], e["fp"], e["fn"], e["support"]) == (1, 2, 0, 1)


def test_unknown_predictions_split_micro_precision_and_recall(spark):
    df = rows_of(spark, [("E", "E"), ("E", "unknown"), ("N", "N"), ("C", "E")])
    row = M.classification_report(M.confusion_counts(df), LETTERS).head()
    assert row["micro_precision"] == pytest.approx(2 / 3)
    assert row["micro_recall"] == 0.5


def test_macro_all_and_present(spark):
    df = rows_of(spark, [("E", "E"), ("E", "E")])
    row = M.classification_report(M.confusion_counts(df), LETTERS).head()
    assert row["macro_f1"] == pytest.approx(1 / 3)
    assert row["macro_f1_present"] == 1.0


def test_empty_input_gives_zeros(spark):
    row = M.classification_report(M.confusion_counts(rows_of(spark, [])), LETTERS).head()
    assert (row["num_examples"], row["accuracy_all"], row["macro_f1"], row["weighted_f1"]) == (0, 0.0, 0.0, 0.0)


def test_confusion_matrix_keeps_zero_rows_and_drops_others(spark):
    df = rows_of(spark, [("E", "E"), ("E", "unknown"), (None, "N"), ("C", "N")])
    rows = M.confusion_matrix(M.confusion_counts(df), LETTERS).collect()
    assert [tuple(r) for r in rows] == [("E", 1, 0, 0), ("N", 0, 0, 0), ("C", 0, 1, 0)]


def test_keys_strata_and_zero_strata(spark):
    df = spark.createDataFrame(
        [("a", "low_entropy", "E", "E"), ("b", "high_entropy", "N", "C"), ("b", "high_entropy", "N", "N")],
        "model string, entropy_class string, gold_label string, predicted_label string",
    )
    counts = M.confusion_counts(df, keys=["model", "entropy_class"])
    report = M.classification_report(counts, LETTERS, ["model"], strata=SU.STRATA).collect()
    got = {(r["model"], r["entropy_class"]): (r["num_examples"], r["accuracy_all"]) for r in report}
    assert got == {
        ("a", "low_entropy"): (1, 1.0), ("a", "high_entropy"): (0, 0.0),
        ("b", "low_entropy"): (0, 0.0), ("b", "high_entropy"): (2, 0.5),
    }
    overall = M.classification_report(M.roll_up(counts, ["model"]), LETTERS, ["model"]).collect()
    assert {r["model"]: r["correct"] for r in overall} == {"a": 1, "b": 1}


def test_errors_and_top3(spark):
    pairs = [("entailment", "neutral")] * 3 + [("neutral", "unknown")] * 3 + [("contradiction", "neutral")] * 2
    pairs += [("neutral", "entailment"), ("neutral", "neutral")]
    errors = M.error_types(M.confusion_counts(rows_of(spark, pairs)))
    top = M.top_errors(errors, [], 3).orderBy("rank").collect()
    assert [(r["error_type"], r["n"]) for r in top] == [
        ("Gold:ENT -> Pred:NEU", 3), ("Gold:NEU -> Pred:UNK", 3), ("Gold:CON -> Pred:NEU", 2),
    ]


def test_majority_lowest_class_wins_ties(spark):
    df = spark.createDataFrame([(2,), (1,), (1,), (2,), (0,)], "label int")
    assert tuple(M.majority_class(df).head()) == (1, 2)


def test_labels_with_quotes(spark):
    df = rows_of(spark, [("it's", "it's"), ("a\\b", "it's")])
    row = M.classification_report(M.confusion_counts(df), ["it's", "a\\b"]).head()
    assert [(c["label"], c["tp"], c["support"]) for c in row["per_class"]] == [("it's", 1, 1), ("a\\b", 0, 1)]


def test_evaluation_summary_document(spark):
    df = spark.createDataFrame(
        [("low_entropy", "entailment", "entailment"), ("low_entropy", "neutral", "unknown")],
        "entropy_class string, gold_label string, predicted_label string",
    )
    counts = M.confusion_counts(df, keys=["entropy_class"])
    document = json.loads(SU.evaluation_summary(counts, stratum="entropy_class").head()["summary"])
    assert document["accuracy"] == 0.5 and document["correct_predictions"] == 1
    assert document["label_distribution"]["gold"] == {"entailment": 1, "neutral": 1, "contradiction": 0}
    low, high = document["entropy_breakdown"]["low_entropy"], document["entropy_breakdown"]["high_entropy"]
    assert low["errors"] == {"Gold:NEU -> Pred:UNK": 1} and low["macro_f1"] == 0.5
    assert high["total"] == 0 and high["errors"] == {} and high["accuracy"] == 0.0
    assert set(low["per_class_metrics"]["neutral"]) == {"f1", "precision", "recall", "support"}


def test_run_summary_document(spark):
    document = json.loads(SU.run_summary(counts_of(spark, G2), model="m", seed=7).head()["summary"])
    assert document == {
        "num_examples": 250, "num_with_gold": 250, "accuracy": 0.312, "unknown_prediction_count": 0,
        "prediction_counts": {"E": 55, "N": 118, "C": 77, "UNKNOWN": 0}, "model": "m", "seed": 7,
    }


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(LETTERS), st.sampled_from([*LETTERS, "unknown"])), min_size=1, max_size=40))
def test_metric_properties(spark, pairs):
    counts = M.confusion_counts(rows_of(spark, pairs))
    row = M.classification_report(counts, LETTERS).head()
    assert sum(c["support"] for c in row["per_class"]) == len(pairs)
    matrix = M.confusion_matrix(counts, LETTERS).collect()
    known = sum(p in LETTERS for _, p in pairs)
    assert sum(sum(r[1:]) for r in matrix) == known
    if known == len(pairs):
        assert row["micro_f1"] == pytest.approx(row["accuracy_all"])
    assert all(0 <= row[k] <= 1 for k in ("macro_f1", "micro_f1", "weighted_f1", "macro_f1_present"))

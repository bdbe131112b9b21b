import pytest
from pyspark.sql import functions as F

from agreelens.operators import annotation as A
from agreelens.sources.row_index import with_row_index

SCHEMA = "annotator_id string, sample_id bigint, ts bigint, action string, labels string, comments string"
LOG = [
    # skip then save: the save wins
    ("a", 0, 1, "skip", None, "c1"), ("a", 0, 2, "save", "x | y", " note "),
    # save then skip: the skip changes nothing
    ("a", 1, 1, "save", "x", None), ("a", 1, 2, "skip", None, "late"),
    # two skips: the first comment stays, untrimmed
    ("a", 2, 1, "skip", None, " keep "), ("a", 2, 2, "skip", None, "second"),
    # empty choice, blank comment
    ("a", 3, 1, "save", None, "  "),
    # blank skip comment
    ("a", 4, 1, "skip", None, " \n"),
    # only viewed
    ("a", 5, 1, "view", None, None),
    # saved twice
    ("b", 0, 5, "save", "y", "new"), ("b", 0, 4, "save", "x", "old"),
]


@pytest.fixture()
def state(spark):
    return A.latest_state(spark.createDataFrame(LOG, SCHEMA).repartition(4))


def test_fold(state):
    got = {(r["annotator_id"], r["sample_id"]): (r["labels"], r["comments"]) for r in state.collect()}
    assert got == {
        ("a", 0): ("x | y", "note"), ("a", 1): ("x", None), ("a", 2): ("Skipped", " keep "), ("a", 3): ("None", None),
        ("a", 4): ("Skipped", None), ("a", 5): (None, None), ("b", 0): ("y", "new"),
    }


def test_sheets_resume_progress(spark, state):
    samples = spark.range(7).select(F.col("id").alias("sample_id"), F.col("id").alias("position"))
    sheet = A.sheets(samples, state, F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    assert sheet.count() == 21
    assert {r["annotator_id"]: r["resume_at"] for r in A.resume_position(sheet).collect()} == {"a": 5, "b": 1, "c": 0}
    compat = A.resume_position(sheet, resume_compat=True)
    assert {r["annotator_id"]: r["resume_at"] for r in compat.collect()}["a"] == 3
    a = A.progress(sheet).filter("annotator_id = 'a'").head()
    assert (a["total"], a["labelled"], a["position_share"]) == (7, 5, 6 / 7)
    done = sheet.filter("annotator_id = 'b' and sample_id = 0")
    assert A.resume_position(done).head()["resume_at"] == 0


def test_positions_are_not_ids(spark):
    log = spark.createDataFrame([("a", 10, 1, "save", "x", None), ("a", 20, 2, "view", None, None)], SCHEMA)
    samples = with_row_index(spark.createDataFrame([(30,), (10,), (20,)], "sample_id bigint"), ["sample_id"], "position")
    sheet = A.sheets(samples, A.latest_state(log), F.array(F.lit("a")))
    assert A.resume_position(sheet).head()["resume_at"] == 1
    assert A.progress(sheet).head()["position_share"] == pytest.approx(2 / 3)


def test_resume_and_progress_without_a_sheet(spark, state):
    """The same answers as from whole sheets: gaps at the start, inside and none, all done and none done, ids that are not positions."""
    log = [(a, 10 * p, i, "save", "x", None) for a, done in {"d": range(7), "e": [0, 1, 2, 5], "f": [1, 2], "g": [6]}.items() for i, p in enumerate(done)]
    both = state.withColumn("sample_id", F.col("sample_id") * 10).unionByName(A.latest_state(spark.createDataFrame(log, SCHEMA)))
    positions = with_row_index(spark.range(7).select((F.col("id") * 10).alias("sample_id")), ["sample_id"], "position")
    names = ["a", "b", "c", "d", "e", "f", "g"]
    annotators = spark.createDataFrame([(n,) for n in names], "annotator_id string")
    sheet = A.sheets(positions, both, F.array(*map(F.lit, names)))
    for compat in (False, True):
        labelled = A.labelled_positions(both, positions, resume_compat=compat)
        got = {r["annotator_id"]: r["resume_at"] for r in A.resume_positions(labelled, annotators, F.lit(7)).collect()}
        assert got == {r["annotator_id"]: r["resume_at"] for r in A.resume_position(sheet, resume_compat=compat).collect()}
        assert (got["c"], got["d"], got["e"], got["f"], got["g"]) == (0, 0, 3, 0, 0)
    logs = spark.createDataFrame(LOG, SCHEMA).unionByName(spark.createDataFrame(log, SCHEMA).withColumn("sample_id", F.col("sample_id") / 10))
    logs = logs.withColumn("sample_id", (F.col("sample_id") * 10).cast("bigint"))
    labelled = A.labelled_positions(both, positions)
    assert sorted(map(tuple, A.labelled_positions_of_log(logs, positions).collect())) == sorted(map(tuple, labelled.collect()))
    got = sorted(map(tuple, A.progress_by_annotator(labelled, annotators, F.lit(7).cast("bigint")).collect()))
    assert got == sorted(map(tuple, A.progress(sheet).collect()))
    # No row per sample and annotator is made, and nothing is sorted.
    text = A.resume_positions(labelled, annotators, F.lit(7))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "SortAggregate" not in text


def test_latest_state_with_ties_and_two_order_columns(spark):
    rows = [("a", 0, 1, 5, "save", f"l{i}", "c") for i in range(5)] + [("a", 0, 1, 5, "save", "l4", "c")]
    rows += [("b", 1, 2, 9, "skip", None, "second"), ("b", 1, 2, 8, "skip", None, "first"), ("b", 1, None, 1, "view", None, None)]
    rows += [("c", 1, None, 3, "save", "without a time", None), ("c", 1, 0, 2, "save", "with one", None), ("d", 1, 7, 7, "view", None, None)]
    df = spark.createDataFrame(rows, "annotator_id string, sample_id bigint, ts bigint, pos bigint, action string, labels string, comments string")
    found = []
    for parts in (1, 7):
        got = {r["annotator_id"]: (r["labels"], r["comments"]) for r in A.latest_state(df.repartition(parts), ["ts", "pos"]).collect()}
        assert got["b"] == ("Skipped", "first") and got["c"] == ("with one", None) and got["d"] == (None, None)
        found.append(got)
    assert found[0] == found[1] and len(found[0]) == 4
    text = A.latest_state(df, ["ts", "pos"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in text and "SortMergeJoin" not in text


def test_options(spark, state):
    rows = {r["option"]: r["n"] for r in A.option_counts(state, ["x", "y", "z"]).collect()}
    assert rows == {"x": 2, "y": 2, "z": 0}


def test_choices_round_trip(spark):
    df = spark.createDataFrame([(["p", "q"],), ([],)], "c array<string>")
    stored = df.select(A.saved_labels(F.col("c")).alias("s"))
    assert [r["s"] for r in stored.collect()] == ["p | q", "None"]
    back = stored.select(A.chosen_options(F.col("s")).alias("o")).collect()
    assert [r["o"] for r in back] == [["p", "q"], []]
    marks = spark.createDataFrame([("Skipped",), (None,)], "s string").select(A.chosen_options(F.col("s")).alias("o"))
    assert [r["o"] for r in marks.collect()] == [[], []]


def test_ensure_columns(spark):
    df = A.ensure_columns(spark.createDataFrame([(1, "t")], "sample_id int, text string"))
    assert df.columns == ["sample_id", "text", "labels", "comments"]
    with pytest.raises(ValueError):
        A.ensure_columns(spark.createDataFrame([("t",)], "text string"))

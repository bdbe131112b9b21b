import pytest
from pyspark.sql import functions as F

from agreelens.operators import latest
from agreelens.operators import responses as R
from agreelens.sources import tables

LINES = """{"custom_id": "id1_run1", "response": {"body": {"choices": [{"message": {"content": "E", "reasoning": "r"}}]}}}

{"custom_id": "id2_run1", "response": {"body": {"choices": [{"message": {"content": null}}]}}}
{"custom_id": "nodigits", "response": {"body": {"choices": []}}}
{"custom_id": "id9", "other": 1}
"""


@pytest.fixture()
def responses(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text(LINES)
    return tables.read_json_lines(spark, str(tmp_path / "r.jsonl"), R.RESPONSE_SCHEMA)


def test_flatten_unknown(responses):
    rows = {r["custom_id"]: (r["content"], r["reasoning"]) for r in R.flatten_responses(responses).collect()}
    assert rows == {"id1_run1": ("E", "r"), "id2_run1": ("", ""), "nodigits": ("", ""), "id9": ("", "")}


def test_flatten_fail(responses):
    with pytest.raises(Exception, match="response without content"):
        R.flatten_responses(responses, on_bad="fail").collect()


def test_predictions(responses):
    rows = {r["item_id"]: r["predicted_label"] for r in R.predictions(R.flatten_responses(responses)).collect()}
    assert rows == {"1": "entailment", "2": "unknown", "nodigits": "unknown", "9": "unknown"}


def test_dedupe_last_wins(spark):
    gold = spark.createDataFrame([("1", 0, "a"), ("1", 5, "b"), ("2", 1, None)], "item_id string, row_id int, x string")
    got = sorted(tuple(r) for r in R.dedupe_gold(gold).select("item_id", "row_id", "x").collect())
    assert got == [("1", 5, "b"), ("2", 1, None)]


def test_match_gold_last_row_counts(spark):
    preds = spark.createDataFrame([("1", "x"), ("1", "y"), ("2", "z")], "item_id string, p string")
    gold = spark.createDataFrame([("1", 5, "b"), ("1", 0, "a"), ("2", 1, "c")], "item_id string, row_id int, g string")
    rows = R.match_gold(preds, gold, order=["row_id"]).select("item_id", "p", "g").collect()
    assert sorted(tuple(r) for r in rows) == [("1", "x", "b"), ("1", "y", "b"), ("2", "z", "c")]


def test_repeated_gold_without_an_order_stops_the_job(spark):
    preds = spark.createDataFrame([("1", "x")], "item_id string, p string")
    gold = spark.createDataFrame([("1", 5, "b"), ("1", 0, "a")], "item_id string, row_id int, g string")
    with pytest.raises(Exception, match="gold repeats values of item_id"):
        R.match_gold(preds, gold).collect()
    assert R.match_gold(preds, gold, unique=True).count() == 2
    assert R.match_gold(preds, gold.filter("row_id = 5")).count() == 1
    labels = gold.withColumnsRenamed({"item_id": "idx", "g": "label"})
    with pytest.raises(Exception, match="the label table repeats values of idx"):
        tables.label_lookup(spark.createDataFrame([("1",)], "idx string"), labels).collect()


def test_last_rows_over_several_packs_nulls_and_copies(spark):
    rows = [(k, a, b, c, f"{k}{a}{b}{c}{x}") for k in ("p", None) for a in (None, -3, 2) for b in (None, -1, 9) for c in (1, None) for x in "yz"]
    rows += rows[:10]
    df = spark.createDataFrame(rows, "k string, a bigint, b bigint, c int, payload string")
    found = [sorted(map(str, latest.last_rows(df.repartition(n), ["k"], ["a", "b", "c"]).collect())) for n in (1, 5)]
    assert found[0] == found[1] and len(found[0]) == 2
    assert all("a=2, b=9, c=1" in r for r in found[0])
    mixed = spark.createDataFrame([("1", 1.5, "b", True), ("1", 1.5, "c", False), ("1", None, "z", True)], "k string, d double, s string, f boolean")
    assert tuple(latest.last_rows(mixed, ["k"], ["d", "s"]).head()) == ("1", 1.5, "c", False)
    when = df.limit(4).select("k", F.expr("timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, 0, 0, 0, c)").alias("t"), F.expr("date'1960-01-01'").alias("d"))
    assert latest.last_rows(when, ["k"], ["d", "t"]).count() == 1


def test_last_rows_neither_sort_nor_gather_payloads(spark):
    df = spark.range(0, 10_000, 1, 4).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("item_id"), F.col("id").alias("row_id"), F.md5(F.col("id").cast("string")).alias("text")
    )
    plan = R.dedupe_gold(df)
    rows = {r["item_id"]: r["row_id"] for r in plan.collect()}
    assert len(rows) == 50 and rows[0] == 9999
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in text and "SortMergeJoin" not in text and "ObjectHashAggregate" not in text
    # The join is on key and order key, so a hot key is spread.
    assert "ShuffledHashJoin" in text or "BroadcastHashJoin" in text


@pytest.mark.parametrize("salts", [1, 4])
def test_match_keeps_repeats_and_drops_unmatched(spark, salts):
    preds = spark.createDataFrame([("1", "x")] * 5 + [("2", "y"), ("7", "z"), (None, "n")], "item_id string, p string")
    gold = spark.createDataFrame([("1", "g1"), ("2", "g2"), ("3", "g3")], "item_id string, g string")
    rows = sorted(tuple(r) for r in R.match_gold(preds, gold, salts=salts).collect())
    assert rows == [("1", "x", "g1")] * 5 + [("2", "y", "g2")]
    assert [r["p"] for r in R.unmatched(preds.dropna(), gold).collect()] == ["z"]


def test_match_refuses_clashing_columns(spark):
    df = spark.createDataFrame([("1", "x")], "item_id string, p string")
    with pytest.raises(ValueError, match="both sides"):
        R.match_gold(df, df)


def test_detailed_records(spark):
    preds = spark.createDataFrame(
        [("id1", "1", "neutral", "t", "why")], "custom_id string, item_id string, predicted_label string, content string, reasoning string"
    )
    gold = spark.createDataFrame(
        [("1", "neutral", "low_entropy", 1.5)], "item_id string, gold_label string, entropy_class string, `mean.noTarget` double"
    )
    row = R.detailed_records(preds, gold).head()
    assert row.asDict() == {
        "custom_id": "id1", "predicted_label": "neutral", "gold_label": "neutral", "is_correct": True,
        "entropy_class": "low_entropy", "raw_model_response": "t", "model_reasoning": "why", "mean.noTarget": 1.5,
    }


def test_hot_item_is_split_by_the_adaptive_planner(spark):
    """One item owns a third of the predictions and gold is de-duplicated and too large to broadcast."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        ids = spark.range(0, 60_000, 1, 8)
        item = F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).cast("string")
        preds = ids.select(item.alias("item_id"), F.sha2(F.col("id").cast("string"), 256).alias("p"))
        gold = ids.select(F.col("id").cast("string").alias("item_id"), F.col("id").alias("row_id"), F.lit("g").alias("g"))
        joined = R.match_gold(preds, R.dedupe_gold(gold))
        assert len(joined.collect()) == 60_000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

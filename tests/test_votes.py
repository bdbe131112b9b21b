import pytest
from pyspark.sql import functions as F

from agreelens.functions import votes as VF
from agreelens.operators import votes as V


def parse(spark, text, policy, **kw):
    df = spark.createDataFrame([(text,)], "votes_str string")
    return df.select(VF.parse_votes(F.col("votes_str"), policy, **kw).alias("v")).head()["v"]


def label(spark, texts, policy, operator):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id int, votes_str string")
    rows = operator(V.bucket_votes(V.parse_votes(df, policy=policy))).collect()
    return {r["item_id"]: r for r in rows}


@pytest.mark.parametrize(
    "text, expected",
    [
        ("3,2,-1,0", [3, 2, -1, 0]),
        (" 3 , +2,\t-1\n", [3, 2, -1]),
        ("1,,2,", [1, 2]),
        ('"1","2"', [1, 2]),
        ('"1,2"', [1, 2]),
        ("", []),
        (" 2,　3", [2, 3]),
    ],
)
def test_strict_parse(spark, text, expected):
    assert parse(spark, text, "fail") == expected


@pytest.mark.parametrize("text", ["x,1", "3.0", "1_0", '" "', "1 2", "\x003"])
def test_strict_parse_fails_on_malformed(spark, text):
    with pytest.raises(Exception, match="malformed vote"):
        parse(spark, text, "fail")


@pytest.mark.parametrize(
    "text, policy, expected",
    [
        ("1,,2", "neutral", [1, None, 2]),
        ("1,,2", "drop", [1, 2]),
        ('1","2', "neutral", [1, 2]),
        ('1","2', "drop", [None, None]),
        ('"1,2"', "drop", [1, 2]),
        ("3.0,1", "drop", [None, 1]),
        ("1_0,1", "neutral", [None, 1]),
        ("\x003,1", "drop", [None, 1]),
        (" \n2 ", "drop", [2]),
        ("99999999999,1", "drop", [99999999999, 1]),
        (None, "drop", []),
        (None, "neutral", [None]),
    ],
)
def test_lenient_parses(spark, text, policy, expected):
    assert parse(spark, text, policy) == expected


def test_skip_empty_can_be_overridden(spark):
    assert parse(spark, "1,,2", "neutral", skip_empty=True) == [1, 2]
    assert parse(spark, "1,,2", "drop", skip_empty=False) == [1, None, 2]


def test_unknown_policy():
    with pytest.raises(ValueError):
        VF.vote_pieces(None, "other")


def test_drop_removes_malformed_and_empty(spark):
    kept = label(spark, ["1,2", "x,1", "", " , ", None, "5,9"], "drop", lambda d: d)
    assert sorted(kept) == [0, 5]


def test_threshold(spark):
    texts = ["1,2,3,1,-1", "1,2,3,-1,-1", "0,0,0,0", "5,1,1,1", "-1,-2,-3,-3,-3", "5,9", "1,1,1,1,1,1,1,1,0,0"]
    rows = label(spark, texts, "drop", V.label_threshold)
    assert [rows[i]["gold_label"] for i in range(7)] == [
        "entailment", None, "neutral", None, "contradiction", None, "entailment",
    ]
    # Votes outside every bucket count in the total.
    assert rows[0]["agreement"] == 0.8 and rows[5]["agreement"] is None


def test_threshold_takes_first_label_in_order(spark):
    rows = label(spark, ["1,0,-1,1"], "drop", lambda d: V.label_threshold(d, min_agreement=0.25))
    assert rows[0]["gold_label"] == "entailment"
    assert rows[0]["agreement"] == 0.5


def test_mean_fallback(spark):
    texts = ["x,1", "", "1,,1", "3,3,3,3", "3,-1", "3,-3", "1,-3", "1,0", "9,0", None]
    rows = label(spark, texts, "neutral", V.label_mean_fallback)
    got = [(rows[i]["gold_label"], rows[i]["agreed"]) for i in range(10)]
    assert got == [
        ("neutral", False), ("neutral", False), ("neutral", False), ("entailment", True), ("entailment", False),
        ("neutral", False), ("contradiction", False), ("entailment", False), ("entailment", False), ("neutral", False),
    ]


def test_plurality_ties_and_strata(spark):
    texts = ["1,-1", "0,-1", "0,1", "0,0,1", "5,9", "1,1,1,1,0", "1,-1,0"]
    rows = label(spark, texts, "drop", V.label_plurality)
    assert [rows[i]["gold_label"] for i in range(7)] == [
        "entailment", "contradiction", "entailment", "neutral", "entailment", "entailment", "entailment",
    ]
    assert [rows[i]["entropy_class"] for i in (4, 5, 6)] == ["high_entropy", "low_entropy", "high_entropy"]


def test_keep_agreed_and_counts(spark):
    df = spark.createDataFrame([("1,1,1",), ("1,-1",), ("0,0",)], "votes_str string")
    buckets = V.bucket_votes(V.parse_votes(df))
    kept = V.keep_agreed(buckets).collect()
    assert sorted((r["gold_label"], r["vote_count"], r["mean_vote"]) for r in kept) == [
        ("entailment", 3, 1.0), ("neutral", 2, 0.0),
    ]
    row = V.agreement_counts(buckets).head()
    assert (row["kept_rows"], row["dropped_rows"], row["kept_contradiction"]) == (2, 1, 0)


def test_user_rules(spark):
    rules = [("high", lambda v: v >= 2), ("low", lambda v: v < 2)]
    df = spark.createDataFrame([("3,2,0",)], "votes_str string")
    row = V.bucket_shares(V.bucket_votes(V.parse_votes(df), rules), rules).head()
    assert (row["n_high"], row["n_low"]) == (2, 1) and row["share_low"] == pytest.approx(1 / 3)


def test_long_votes_give_the_same_buckets(spark):
    text = spark.createDataFrame([(1, "3,0,-2"), (2, "5,1")], "item_id int, votes_str string")
    rows = spark.createDataFrame([(1, 3), (1, 0), (1, -2), (2, 5), (2, 1)], "item_id int, vote int")
    columns = ["item_id", "vote_count", "vote_sum", "n_entailment", "n_neutral", "n_contradiction"]
    a = V.bucket_votes(V.parse_votes(text)).select(*columns)
    assert sorted(a.collect()) == sorted(V.bucket_long_votes(rows).select(*columns).collect())


def test_very_long_vote_string(spark):
    text = ",".join(["1"] * 200_000)
    df = spark.createDataFrame([(text,)], "votes_str string")
    row = V.label_plurality(V.bucket_votes(V.parse_votes(df))).head()
    assert row["vote_count"] == 200_000 and row["entropy_class"] == "low_entropy"


def test_items_without_votes_count_as_dropped(spark):
    items = spark.createDataFrame([("a", "1,2"), ("b", ""), ("c", None), ("d", "1,x")], "item_id string, votes_str string")
    parsed = V.parse_votes(items, policy="neutral", skip_empty=True).filter("not votes_bad")
    row = V.agreement_counts(V.bucket_votes(parsed)).head()
    assert (row["kept_rows"], row["dropped_rows"]) == (1, 2)

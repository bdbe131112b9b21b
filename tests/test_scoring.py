import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from agreelens.operators import scoring as S

TOKENS = [(0, "E"), (1, " E"), (2, "N"), (3, "C\n"), (4, "EE"), (5, "e"), (6, "")]


@pytest.fixture()
def tokens(spark):
    return spark.createDataFrame(TOKENS, "token_id int, decoded string")


def lse(xs):
    m = max(xs)
    return m if math.isinf(m) else m + math.log(sum(math.exp(x - m) for x in xs))


VECTORS = [
    [0.0, 0.0, 0.5, 0.25, 9.0, 9.0, 9.0],
    [1000.0, 999.0, -1000.0, 0.0, 0.0, 0.0, 0.0],
    [-1200.0, -1201.5, -1200.0, -1300.0, 0.0, 0.0, 0.0],
    [-math.inf, 2.0, -math.inf, 1.0, 0.0, 0.0, 0.0],
    [499.0, 501.0, -499.0, 3.4e38, 0.0, 0.0, 0.0],
]


def test_label_tokens(tokens):
    got = sorted((r["token_id"], r["label"]) for r in S.label_tokens(tokens).collect())
    assert got == [(0, "E"), (1, "E"), (2, "N"), (3, "C")]


def test_missing_label_token_fails(spark, tokens):
    vectors = spark.createDataFrame([(1, VECTORS[0])], "item_id int, logits array<double>")
    with pytest.raises(Exception, match="no single token for labels: N"):
        S.logits_from_vectors(vectors, tokens.filter("token_id <> 2")).collect()


@pytest.mark.parametrize("form", ["dense", "long"])
def test_logits_stay_finite_and_exact(spark, tokens, form):
    df = spark.createDataFrame(list(enumerate(VECTORS)), "item_id int, logits array<double>")
    if form == "dense":
        out = S.logits_from_vectors(df, tokens)
    else:
        out = S.logits_from_long(df.select("item_id", F.posexplode("logits").alias("token_id", "logit")), tokens)
    rows = {r["item_id"]: r for r in out.collect()}
    for i, v in enumerate(VECTORS):
        for letter, ids in (("E", [0, 1]), ("N", [2]), ("C", [3])):
            assert rows[i][f"logit_{letter}"] == pytest.approx(lse([v[j] for j in ids]), rel=1e-13), (i, letter)


def test_null_logits_and_tokens_beyond_the_vector(spark, tokens):
    vectors = [[1.0, None, None, 2.0, 0.0, 0.0, 0.0], [None] * 7]
    df = spark.createDataFrame([*enumerate(vectors), (2, None)], "item_id int, logits array<double>")
    dense = {r["item_id"]: tuple(r)[2:] for r in S.logits_from_vectors(df, tokens).collect()}
    long = df.select("item_id", F.posexplode("logits").alias("token_id", "logit"))
    by_band = {r["item_id"]: tuple(r)[1:] for r in S.logits_from_long(long, tokens).collect()}
    assert dense[0] == (pytest.approx(1.0), None, pytest.approx(2.0)) and dense[1] == dense[2] == (None, None, None)
    assert by_band == {0: dense[0], 1: dense[1]}
    short = spark.createDataFrame([(0, [1.0, 2.0, 3.0])], "item_id int, logits array<double>")
    with pytest.raises(Exception, match="token id beyond the logit vector: 3"):
        S.logits_from_vectors(short, tokens).collect()


def test_batches_of_like_lengths_waste_little(spark):
    df = spark.range(0, 20_000, 1, 4).select("id", F.repeat(F.lit("x"), (F.pmod(F.xxhash64("id"), F.lit(20)) ** 2 + 1).cast("int")).alias("llm_prompt"))
    before = S.padding_share(df, "llm_prompt", 64).head()
    grouped = S.by_length(df, "llm_prompt", partitions=4)
    after = S.padding_share(grouped, "llm_prompt", 64).head()
    assert before["characters"] == after["characters"] and before["padding_share"] > 0.6 and after["padding_share"] < 0.05
    # No task gets all the long texts.
    work = [r["n"] for r in grouped.groupBy(F.spark_partition_id()).agg(F.sum(F.length("llm_prompt")).alias("n")).collect()]
    assert max(work) < 1.3 * min(work)

    def make_scorer():
        return lambda texts: np.array([[len(t), 0.0, 1.0] for t in texts])

    scored = S.score_batches(df, make_scorer, group_lengths=True)
    assert scored.count() == 20_000 and scored.filter("logit_E <> length(llm_prompt)").count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (2, "")], "id int, llm_prompt string")
    assert S.by_length(odd, "llm_prompt").count() == 3 and S.by_length(odd.limit(0), "llm_prompt").count() == 0


def test_many_copies_of_one_item(spark, tokens):
    copies = spark.range(0, 50_000, 1, 8).select(
        F.lit("hot").alias("item_id"), (F.col("id") % 4).cast("int").alias("token_id"), F.lit(700.0).alias("logit")
    )
    row = S.logits_from_long(copies, tokens).head()
    assert row["logit_E"] == pytest.approx(700 + math.log(25_000), rel=1e-12)


def test_probabilities_and_ties(spark):
    df = spark.createDataFrame(
        [(1, 0.0, 0.0, 0.0), (2, 0.0, 1.0, 1.0), (3, 1e4, -1e4, 0.0), (4, -5.0, -6.0, -4.5)],
        "i int, logit_E double, logit_N double, logit_C double",
    )
    rows = {r["i"]: r for r in S.predict_label(S.label_probabilities(df)).collect()}
    assert [rows[i]["prediction"] for i in (1, 2, 3, 4)] == ["E", "N", "E", "C"]
    for r in rows.values():
        assert r["prob_E"] + r["prob_N"] + r["prob_C"] == pytest.approx(1.0, abs=1e-12)


def test_scored_predictions_record(spark):
    df = spark.createDataFrame(
        [(0, 2.0, 1.0, 0.0), (None, 2.0, 1.0, 0.0)], "label int, logit_E double, logit_N double, logit_C double"
    )
    rows = S.scored_predictions(df, "label", S.legacy_convention(df)).collect()
    known = next(r for r in rows if r["label"] == 0)
    unknown = next(r for r in rows if r["label"] is None)
    assert known["gold_label"] == "E" and known["is_correct"] is True
    assert unknown["gold_label"] is None and unknown["is_correct"] is False
    assert known["label_logits"]["E"] == 2.0
    assert sum(known["label_probabilities"]) == pytest.approx(1.0)


@pytest.mark.parametrize(
    "codes, any_rule, subset_rule",
    [([0, 1, 2], False, False), ([-1, 0, 1], True, True), ([0, 1], False, True), ([-1, 2], True, False), ([None], False, True)],
)
def test_conventions(spark, codes, any_rule, subset_rule):
    df = spark.createDataFrame([(c,) for c in codes], "label int")
    row = df.select(
        S.legacy_convention(df).alias("a"), S.legacy_convention(df, rule="subset").alias("s")
    ).head()
    assert (row["a"], row["s"]) == (any_rule, subset_rule)


def test_score_batches_and_layers(spark):
    def make_scorer():
        return lambda texts: np.array([[len(t), 1.0, 2.0] for t in texts])

    def make_encoder():
        return lambda texts: np.array([[len(t) + k for k in range(6)] for t in texts], dtype="float32")

    df = spark.createDataFrame([(1, "abc"), (2, "")], "item_id int, llm_prompt string")
    rows = {r["item_id"]: r for r in S.score_batches(df, make_scorer).collect()}
    assert (rows[1]["logit_E"], rows[2]["logit_E"], rows[2]["logit_C"]) == (3.0, 0.0, 2.0)
    reps = S.layer_representations(df.withColumnRenamed("llm_prompt", "text"), make_encoder, layers=3)
    got = {(r["item_id"], r["layer"]): r["vec"] for r in reps.collect()}
    assert got[1, 0] == [3.0, 4.0] and got[1, 2] == [7.0, 8.0] and len(got) == 6

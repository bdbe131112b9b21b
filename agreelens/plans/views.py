"""Input shapes of the operators, derived from the driver's star-schema and text tables.

Every view covers its whole source tables. The formulas only rename and recode values, so the same views can
be written in plain SQL for the oracles (``oracles.py``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.probes import layer_slices

VOTE_VALUES = (-3, -2, -1, 0, 1, 2, 3)
RESPONSE_WORDS = {0: "Entailment", 1: "contradiction", 2: "neutral", 3: "E", 4: "N", 5: "C"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vote: ``item_id, vote``."""
    order, part = F.col("l_orderkey"), F.col("l_partkey")
    vote = (
        F.when(order % 5 == 0, 1 + part % 3)
        .when(order % 5 == 1, -1 - part % 3)
        .when(order % 5 == 2, F.lit(0))
        .otherwise(part % 7 - 3)
    )
    return table(spark, sf_dir, "lineitem").select(order.alias("item_id"), vote.cast("int").alias("vote"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per item: ``item_id, votes_str, verb, genre``, some vote strings empty or malformed.

    The sorted vote string is spelled out from seven counts per item, so the shuffle carries partially
    aggregated counts and never a list of votes.
    """
    counted = long_votes(spark, sf_dir).groupBy("item_id").agg(
        *[F.count_if(F.col("vote") == v).cast("int").alias(f"c{i}") for i, v in enumerate(VOTE_VALUES)]
    )
    spelled = F.concat(*[F.repeat(F.lit(f"{v},"), F.col(f"c{i}")) for i, v in enumerate(VOTE_VALUES)])
    joined = F.rtrim(spelled, F.lit(","))
    votes_str = (
        F.when(F.col("item_id") % 101 == 0, F.lit(""))
        .when(F.col("item_id") % 97 == 0, F.concat(joined, F.lit(",x")))
        .otherwise(joined)
    )
    features = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("verb"), F.col("o_orderstatus").alias("genre")
    )
    return counted.select("item_id", votes_str.alias("votes_str")).join(features, "item_id")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return response_columns(table(spark, sf_dir, "orders"))


def response_columns(orders: DataFrame) -> DataFrame:
    """Nested chat responses with ``run``: ``custom_id, response, run``; from a batch or a stream."""
    word = F.lit("")
    for code, text in RESPONSE_WORDS.items():
        word = F.when(F.col("o_custkey") % 7 == code, F.lit(text)).otherwise(word)
    message = F.struct(word.alias("content"), F.col("o_orderpriority").alias("reasoning"))
    choice = F.struct(message.alias("message"))
    return orders.select(
        F.concat(F.lit("id"), F.col("o_orderkey").cast("string"), F.lit("_run1")).alias("custom_id"),
        F.struct(F.struct(F.array(choice).alias("choices")).alias("body")).alias("response"),
        (F.col("o_custkey") % 3).cast("int").alias("run"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Premise and hypothesis: a user turn and the assistant turn that answers it."""
    turns = table(spark, sf_dir, "conversations")
    user = turns.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("premise"))
    reply = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis")
    )
    return user.join(reply, ["conv_id", "turn"])


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with a correctness flag and features."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", "n_chars", F.length("text").alias("text_length")
    )
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    flag = (F.col("n_chars") > 1000) == (F.col("quality") == 1)
    return joined.withColumn("is_correct", flag)


EVAL_NUMERIC = ("n_chars", "text_length")
EVAL_CATEGORICAL = ("lang", "source", "toxic")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token table: every vector position, with its text."""
    width = table(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding")).alias("width"))
    positions = width.select(F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("token_id"))
    t = F.col("token_id")
    letter = F.when(t % 8 == 0, F.lit("E")).when(t % 8 == 1, F.lit("N")).when(t % 8 == 2, F.lit("C"))
    padded = F.concat(F.when(F.floor(t / 8) % 2 == 1, F.lit(" ")).otherwise(F.lit("")), letter)
    decoded = F.coalesce(padded, F.concat(F.lit("tok"), t.cast("string")))
    return positions.select("token_id", decoded.alias("decoded"))


def logit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dense logit vector per item, with a raw gold code of mixed type (a number or text)."""
    code = F.col("label") % 4 - 1
    raw = F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit('"'), code.cast("string"), F.lit('"'))).otherwise(
        code.cast("string")
    )
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"),
        F.col("embedding").alias("logits"),
        code.alias("code"),
        F.parse_json(raw).alias("raw_gold"),
    )


def long_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per item and token."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.posexplode("embedding").alias("token_id", "logit")
    )


LAYERS = 4


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Representations: ``item_id, label, group, layer, vec``."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"),
        (F.col("label") % 3).alias("label"),
        (F.col("vec_id") % 7).cast("int").alias("group"),
        layer_slices(F.col("embedding"), LAYERS).alias("parts"),
    )
    return vectors.select("item_id", "label", "group", F.posexplode("parts").alias("layer", "vec"))


def sample_number(event_id: Column) -> Column:
    """Sample ids with gaps, not from 0: a place in the set is not an id."""
    return 10 + 3 * (event_id % 200)


def annotation_log(events: DataFrame) -> DataFrame:
    """Log of views, skips and saves; takes a batch or a streaming ``events`` table."""
    action = (
        F.when(F.col("event_type") == "view", F.lit("view"))
        .when(F.col("event_type") == "error", F.lit("skip"))
        .otherwise(F.lit("save"))
    )
    labels = F.when(F.col("event_type") == "purchase", F.lit("purchase | click")).when(
        F.col("event_type") == "click", F.lit("click")
    )
    return events.select(
        (F.col("user_id") % 10).alias("annotator_id"),
        sample_number(F.col("event_id")).alias("sample_id"),
        F.col("event_id").alias("ts"),
        action.alias("action"),
        labels.alias("labels"),
        F.when(F.col("event_id") % 4 == 0, F.lit("  ")).otherwise(F.col("props")).alias("comments"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(sample_number(F.col("event_id")).alias("sample_id")).distinct()

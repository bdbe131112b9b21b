"""Votes to gold labels under three policies.

All label policies read the same bucket columns (``vote_count``, ``vote_sum``, ``n_<label>``). These come
either from a vote string per item (``bucket_votes``, a pure projection) or from one row per vote
(``bucket_long_votes``, one partially aggregated shuffle that no hot item can overload).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import votes as V
from ..functions.constants import HIGH_ENTROPY, LOW_ENTROPY, MIN_AGREEMENT, NEUTRAL_MEAN


def parse_votes(
    df: DataFrame, raw: str = "votes_str", policy: str = "drop", skip_empty: bool | None = None
) -> DataFrame:
    """Add ``votes`` and ``votes_bad``; "drop" also removes items that are malformed or have no vote.

    The array is produced by a one-element generator. A plain projection would be merged into the filter and
    into every later use, and each of them would parse the string again.
    """
    parsed = df.select("*", F.explode(F.array(V.parse_votes(F.col(raw), policy, skip_empty))).alias("votes"))
    out = parsed.withColumn("votes_bad", V.has_malformed(F.col("votes")))
    if policy == "drop":
        out = out.filter(~F.col("votes_bad") & (F.size("votes") > 0))
    return out


def bucket_votes(df: DataFrame, rules: Sequence[V.BucketRule] = V.VOTE_BUCKETS) -> DataFrame:
    """Add bucket counts of the ``votes`` array. Votes outside every bucket still count in the total."""
    votes = F.col("votes")
    return df.select(
        "*",
        F.size(votes).alias("vote_count"),
        V.vote_sum(votes).alias("vote_sum"),
        *[V.bucket_count(votes, rule).alias(f"n_{label}") for label, rule in rules],
    )


def bucket_long_votes(
    df: DataFrame,
    item: str = "item_id",
    vote: str = "vote",
    keys: Sequence[str] = (),
    rules: Sequence[V.BucketRule] = V.VOTE_BUCKETS,
) -> DataFrame:
    """Bucket counts from one row per vote, with map-side combine; no vote list is ever built."""
    v = F.col(vote)
    return df.groupBy(*keys, item).agg(
        F.count(v).cast("int").alias("vote_count"),
        F.sum(v).cast("bigint").alias("vote_sum"),
        *[F.count_if(rule(v)).cast("int").alias(f"n_{label}") for label, rule in rules],
    )


def bucket_shares(df: DataFrame, rules: Sequence[V.BucketRule] = V.VOTE_BUCKETS) -> DataFrame:
    return df.select(
        "*", *[F.try_divide(f"n_{label}", "vote_count").alias(f"share_{label}") for label, _ in rules]
    )


def _counts(labels: Sequence[str]) -> list[tuple[str, Column]]:
    return [(label, F.col(f"n_{label}")) for label in labels]


def label_threshold(
    df: DataFrame,
    min_agreement: float = MIN_AGREEMENT,
    labels: Sequence[str] = ("entailment", "neutral", "contradiction"),
) -> DataFrame:
    """Add ``gold_label`` and ``agreement``: the first label that enough annotators chose, else NULL."""
    total = F.col("vote_count")
    label = V.first_agreed(_counts(labels), total, min_agreement)
    share = F.lit(None).cast("double")
    for name, n in reversed(_counts(labels)):
        share = F.when(F.col("gold_label") == name, F.try_divide(n, total)).otherwise(share)
    return df.withColumn("gold_label", label).withColumn("agreement", share)


def label_mean_fallback(df: DataFrame, min_agreement: float = MIN_AGREEMENT) -> DataFrame:
    """Add ``gold_label`` and ``agreed``: threshold label, else the sign of the mean vote.

    Malformed and empty vote strings are neutral without agreement.
    """
    agreed = V.first_agreed(_counts(["entailment", "neutral", "contradiction"]), F.col("vote_count"), min_agreement)
    mean = F.try_divide("vote_sum", "vote_count")
    label = (
        F.when(F.col("_agreed").isNotNull(), F.col("_agreed"))
        .when(F.abs(mean) < NEUTRAL_MEAN, F.lit("neutral"))
        .when(mean > 0, F.lit("entailment"))
        .otherwise(F.lit("contradiction"))
    )
    usable = F.lit(True) if "votes_bad" not in df.columns else ~F.col("votes_bad")
    usable = usable & (F.col("vote_count") > 0)
    return (
        df.withColumn("_agreed", F.when(usable, agreed))
        .withColumn("gold_label", F.when(usable, label).otherwise(F.lit("neutral")))
        .withColumn("agreed", F.col("_agreed").isNotNull())
        .drop("_agreed")
    )


def label_plurality(df: DataFrame, min_agreement: float = MIN_AGREEMENT) -> DataFrame:
    """Add ``gold_label`` and ``entropy_class``: the most frequent bucket.

    Ties go to entailment, then contradiction. When every vote lies outside the buckets all shares are
    zero, which is a tie too.
    """
    e, n, c = F.col("n_entailment"), F.col("n_neutral"), F.col("n_contradiction")
    top = F.greatest(e, n, c)
    return df.withColumn(
        "gold_label",
        F.when(top == e, F.lit("entailment")).when(top == c, F.lit("contradiction")).otherwise(F.lit("neutral")),
    ).withColumn(
        "entropy_class",
        F.when(F.try_divide(top, F.col("vote_count")) >= min_agreement, F.lit(LOW_ENTROPY)).otherwise(
            F.lit(HIGH_ENTROPY)
        ),
    )


def keep_agreed(df: DataFrame, min_agreement: float = MIN_AGREEMENT) -> DataFrame:
    """Items whose threshold label exists, with ``agreement``, ``vote_count`` and ``mean_vote`` as doubles."""
    return (
        label_threshold(df, min_agreement)
        .filter(F.col("gold_label").isNotNull())
        .withColumn("mean_vote", F.try_divide("vote_sum", "vote_count"))
    )


def agreement_counts(df: DataFrame, keys: Sequence[str] = (), min_agreement: float = MIN_AGREEMENT) -> DataFrame:
    """Kept and dropped item counts, and kept items per label, in one pass."""
    labelled = label_threshold(df, min_agreement)
    label = F.col("gold_label")
    return labelled.groupBy(*keys).agg(
        F.count_if(label.isNotNull()).alias("kept_rows"),
        F.count_if(label.isNull()).alias("dropped_rows"),
        *[F.count_if(label == x).alias(f"kept_{x}") for x in ("entailment", "neutral", "contradiction")],
    )

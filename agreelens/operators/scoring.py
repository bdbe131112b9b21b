"""Labels from next-token logits, and batched scoring with a user-supplied model."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import LETTERS
from ..functions.labels import normalize_gold
from ..functions.logits import first_max, log_sum_exp, softmax
from ..functions.text import py_strip
from .responses import is_correct

# exp() of anything below this width fits a double with room for sums.
_BAND = 500.0


def label_tokens(tokens: DataFrame, labels: Sequence[str] = LETTERS) -> DataFrame:
    """Token ids whose text is exactly a label."""
    text = py_strip(F.col("decoded"))
    return tokens.filter(text.isin(*labels)).select("token_id", text.alias("label"))


def label_token_ids(tokens: DataFrame, labels: Sequence[str] = LETTERS) -> Column:
    """Label to sorted token ids as a scalar subquery; the query fails if a label has no token.

    The table is a vocabulary, so the lists are bounded by its few spellings of single letters.
    """
    found = label_tokens(tokens, labels)
    lists = [
        F.array_sort(F.collect_set(F.when(F.col("label") == x, F.col("token_id")))).alias(x) for x in labels
    ]
    missing = F.concat(
        F.lit("no single token for labels: "),
        F.concat_ws(", ", *[F.when(F.size(x) == 0, F.lit(x)) for x in labels]),
    )
    complete = F.least(*[F.size(x) for x in labels]) > 0
    checked = F.when(complete, F.struct(*labels)).otherwise(
        F.raise_error(missing).cast(T.StructType([T.StructField(x, T.ArrayType(T.LongType())) for x in labels]))
    )
    cast = [F.col(x).cast("array<bigint>").alias(x) for x in labels]
    return found.agg(*lists).select(*cast).select(checked.alias("ids")).scalar()


def logits_from_vectors(
    df: DataFrame, tokens: DataFrame, vector: str = "logits", labels: Sequence[str] = LETTERS
) -> DataFrame:
    """Add ``logit_<label>`` from one dense logit vector per item: a projection, no explode, no shuffle.

    A NULL in a vector is left out of its label's sum; a label without any value has a NULL logit; a label token beyond the vector's end
    stops the job.
    """
    with_ids = df.withColumn("_ids", label_token_ids(tokens, labels))

    def value(i: Column) -> Column:
        beyond = F.concat(F.lit("token id beyond the logit vector: "), i.cast("string"))
        inside = (i >= 0) & (i < F.size(F.col(vector)))
        return F.when(F.col(vector).isNull() | inside, F.get(F.col(vector), i.cast("int")).cast("double")).otherwise(
            F.raise_error(beyond).cast("double")
        )

    def known(values: Column) -> Column:
        return F.when(F.size(values) > 0, log_sum_exp(values))

    return with_ids.select(
        *df.columns,
        *[known(F.filter(F.transform(F.col(f"_ids.{x}"), value), lambda v: v.isNotNull())).alias(f"logit_{x}") for x in labels],
    )


def logits_from_long(
    logits: DataFrame,
    tokens: DataFrame,
    item: str = "item_id",
    labels: Sequence[str] = LETTERS,
    keys: Sequence[str] = (),
) -> DataFrame:
    """``logit_<label>`` per item from rows ``(item, token_id, logit)``.

    Only rows of label tokens pass the first filter, a handful per item; the token lists are a subquery
    result, so there is no join that could shuffle a whole vocabulary per item. A log-sum-exp needs
    a shift to stay finite; instead of first finding each group's maximum (a second pass, or a window that
    holds a whole group), every value is summed within its own band of fixed width. Band sums are plain
    partial aggregates, and the few bands of an item are combined at the end relative to the highest one. NULL logits are left out. A label all of whose
    logits are NULL has a NULL logit; one without rows has minus infinity, as where only the highest logits are kept.
    """
    label = F.lit(None).cast("string")
    for name in reversed(labels):
        is_token = F.array_contains(F.col(f"_ids.{name}"), F.col("token_id").cast("bigint"))
        label = F.when(is_token, F.lit(name)).otherwise(label)
    labelled = logits.withColumn("_ids", label_token_ids(tokens, labels)).withColumn("label", label)
    scored = labelled.filter(F.col("label").isNotNull())
    x = F.col("logit").cast("double")
    # Above the range of whole bands (no real model gets there) the value is its own band.
    huge = (F.abs(x) >= 1e17) & (F.abs(x) < float("inf"))
    banded = scored.withColumn("_band", F.when(huge, x / _BAND).otherwise(F.floor(x / _BAND).cast("double")))
    # An item of NULL logits alone still has a row; its bands are left out below.
    sums = banded.groupBy(*keys, item, "label", "_band").agg(F.sum(F.exp(x - F.col("_band") * _BAND)).alias("_s"))
    top = sums.groupBy(*keys, item).agg(
        *[
            F.map_from_entries(
                F.collect_list(F.when((F.col("label") == label) & F.col("_band").isNotNull(), F.struct("_band", "_s")))
            ).alias(f"_{label}")
            for label in labels
        ],
        *[F.count_if(F.col("label") == label).alias(f"_rows_{label}") for label in labels],
    )

    def combined(x: str) -> Column:
        all_null = (F.size(f"_{x}") == 0) & (F.col(f"_rows_{x}") > 0)
        return F.when(~all_null, _combine_bands(F.col(f"_{x}"))).alias(f"logit_{x}")

    return top.select(*keys, item, *map(combined, labels))


def _combine_bands(bands: Column) -> Column:
    highest = F.array_max(F.map_keys(bands))
    total = F.aggregate(
        F.map_entries(bands),
        F.lit(0.0),
        lambda acc, e: acc + e["value"] * F.exp((e["key"] - highest) * _BAND),
    )
    return F.when(total == 0, F.lit(float("-inf"))).otherwise(highest * _BAND + F.ln(total))


def label_probabilities(df: DataFrame, labels: Sequence[str] = LETTERS) -> DataFrame:
    """Add ``prob_<label>``: softmax over the label set, within the row."""
    probs = softmax([F.col(f"logit_{x}") for x in labels])
    return df.select("*", *[p.alias(f"prob_{x}") for p, x in zip(probs, labels)])


def predict_label(df: DataFrame, labels: Sequence[str] = LETTERS) -> DataFrame:
    """Add ``prediction``; on equal probabilities the earlier label wins."""
    return df.withColumn("prediction", first_max([F.col(f"prob_{x}") for x in labels], labels))


def scored_predictions(
    df: DataFrame,
    gold: str,
    legacy: Column | bool = False,
    labels: Sequence[str] = LETTERS,
) -> DataFrame:
    """Item columns plus prediction, logits, probabilities, normalised gold label and correctness."""
    kind = df.schema[gold].dataType.simpleString()
    scored = predict_label(label_probabilities(df, labels), labels)
    rest = [c for c in df.columns if not c.startswith("logit_")]
    out = scored.withColumn("gold_label", normalize_gold(F.col(gold), kind, legacy))
    return out.select(
        *rest,
        "prediction",
        F.struct(*[F.col(f"logit_{x}").alias(x) for x in labels]).alias("label_logits"),
        F.struct(*[F.col(f"prob_{x}").alias(x) for x in labels]).alias("label_probabilities"),
        "gold_label",
        is_correct(F.col("prediction"), F.col("gold_label")).alias("is_correct"),
    )


def legacy_convention(df: DataFrame, label: str = "label", rule: str = "any") -> Column:
    """Whether integer codes follow the older convention, decided over the whole set.

    A scalar subquery, hence no join and no driver round trip. ``any``: some code is -1. ``subset``: all
    codes are among -1, 0, 1.
    """
    code = F.col(label)
    if rule == "any":
        test = F.coalesce(F.bool_or(code == -1), F.lit(False))
    elif rule == "subset":
        test = F.coalesce(F.bool_and(code.isin(-1, 0, 1)), F.lit(True))
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return df.agg(test.alias("legacy")).scalar()


def keyed_convention(df: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """The same decision per key set (for instance per input file), as a small table to join on."""
    code = F.col(label)
    return df.groupBy(*keys).agg(
        F.coalesce(F.bool_or(code == -1), F.lit(False)).alias("legacy_any"),
        F.coalesce(F.bool_and(code.isin(-1, 0, 1)), F.lit(True)).alias("legacy_subset"),
        F.count_distinct(code).alias("distinct_codes"),
    )


def by_length(df: DataFrame, column: str, bands: int = 256, seed: int = 7, partitions: int | None = None) -> DataFrame:
    """Rows regrouped so that neighbours in a task are about equally long, and all tasks have work of all lengths.

    Lengths are cut into ``bands`` by approximate quantiles. A seeded hash deals the bands' rows to tasks, so that no task gets all long
    texts and a hot band is spread; within its task, rows lie in order of length. A batch that is padded to its longest text
    then wastes little. The order of rows changes: results belong to them by their own keys, never by position.
    """
    length = F.coalesce(F.length(F.col(column)), F.lit(0))
    # One row of as many numbers as there are bands.
    quantiles = F.percentile_approx("_length", [i / bands for i in range(1, bands)], 10 * bands)
    edges = df.select(length.alias("_length")).agg(quantiles.alias("edges")).head()["edges"] or []
    band = F.size(F.filter(F.lit(sorted(set(edges))).cast("array<int>"), lambda e: e < length))
    spread = F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns if c != column], column), F.lit(1 << 20))
    dealt = df.withColumns({"_length": length, "_band": band, "_spread": spread})
    count = [partitions] if partitions else []
    # A task takes whole stretches of a band, long enough for several batches.
    dealt = dealt.repartition(*count, "_band", F.pmod("_spread", F.lit(64)))
    return dealt.sortWithinPartitions("_length", "_spread").select(*[F.col(f"`{c}`") for c in df.columns])


def padding_share(df: DataFrame, column: str, batch_size: int) -> DataFrame:
    """One row: characters, characters after padding each batch of neighbouring rows to its longest, and the share that is padding."""
    length = F.coalesce(F.length(F.col(column)), F.lit(0)).cast("long")
    place = F.monotonically_increasing_id()
    rows = df.select(length.alias("_length"), F.shiftright(place, 33).alias("_task"), F.floor(place.bitwiseAND((1 << 33) - 1) / batch_size).alias("_batch"))
    batches = rows.groupBy("_task", "_batch").agg(F.sum("_length").alias("own"), (F.max("_length") * F.count(F.lit(1))).alias("padded"))
    own, padded = F.sum("own"), F.sum("padded")
    return batches.agg(own.alias("characters"), padded.alias("padded"), F.try_divide(padded - own, padded).alias("padding_share"))


def score_batches(
    df: DataFrame,
    make_scorer: Callable[[], Callable],
    column: str = "llm_prompt",
    labels: Sequence[str] = LETTERS,
    batch_size: int = 64,
    group_lengths: bool = False,
) -> DataFrame:
    """Add ``logit_<label>`` from a model.

    ``make_scorer`` runs once per Python worker and returns a function from a batch of texts to an array of
    shape (batch, labels). Batches travel by Arrow; the model never leaves the executors. ``group_lengths`` shuffles rows so that
    a batch holds texts of like lengths (``by_length``): worth it where a model pads its batches.
    """
    score = predict_batch_udf(make_scorer, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)
    rows = by_length(df, column) if group_lengths else df
    scored = rows.withColumn("_scores", score(F.col(column)))
    return scored.select(
        *df.columns, *[F.get("_scores", F.lit(i)).alias(f"logit_{x}") for i, x in enumerate(labels)]
    )


def layer_representations(
    df: DataFrame,
    make_encoder: Callable[[], Callable],
    layers: int,
    column: str = "text",
    batch_size: int = 16,
) -> DataFrame:
    """One row per item and layer with ``vec``, from a model returning (batch, layers * width) floats."""
    encode = predict_batch_udf(make_encoder, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    width = (F.size("_flat") / layers).cast("int")
    parts = F.transform(
        F.sequence(F.lit(0), F.lit(layers - 1)), lambda i: F.slice(F.col("_flat"), i * width + 1, width)
    )
    rest = [c for c in df.columns if c != column]
    return df.withColumn("_flat", encode(F.col(column))).select(*rest, F.posexplode(parts).alias("layer", "vec"))



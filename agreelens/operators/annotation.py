"""Annotation sheets from a log of saves and skips.

A log row is ``(annotator_id, sample_id, <order>, action, labels, comments)`` with action ``save``, ``skip``
or anything else (a mere view).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import ANNOTATION_OPTIONS, CHOICE_SEPARATOR, NO_CHOICE, SKIPPED
from ..functions.text import nonblank, py_strip
from .joins import splittable_join
from .latest import matching, order_packs, winners

STATE_KEYS = ("annotator_id", "sample_id")


def saved_labels(choices: Column) -> Column:
    """Chosen options as stored text; an empty choice is stored as ``None``."""
    return F.when(F.size(choices) > 0, F.array_join(choices, CHOICE_SEPARATOR)).otherwise(F.lit(NO_CHOICE))


def chosen_options(labels: Column) -> Column:
    """Stored text back to a list of options; empty for NULL and for the two marker values."""
    options = F.transform(F.split(labels, r" \| "), py_strip)
    real = labels.isNotNull() & ~labels.isin(SKIPPED, NO_CHOICE)
    return F.when(real, options).otherwise(F.array().cast("array<string>"))


def state_aggregates(order: Sequence[str] = ("ts",)) -> list[Column]:
    """The fold of one sample's log, as aggregates that need no sorting and combine partially.

    The last save wins. A skip marks the sample only while it has no label, so only the first skip counts,
    and only if nothing was ever saved. The same aggregates serve batch and stream.
    """
    position = F.struct(*[F.col(c) for c in order])
    save, skip = F.col("action") == "save", F.col("action") == "skip"
    entry = F.struct("labels", "comments")
    # max_by and min_by ignore rows whose ordering value is NULL.
    return [
        F.max_by(entry, F.when(save, position)).alias("_saved"),
        F.min_by(entry, F.when(skip, position)).alias("_skipped"),
    ]


def unpack_state(df: DataFrame, keys: Sequence[str] = STATE_KEYS) -> DataFrame:
    """Stored labels and comment from the two entries: a saved comment is trimmed, a skip's is kept unless blank."""
    saved, skipped = F.col("_saved"), F.col("_skipped")
    labels = F.when(saved.isNotNull(), F.coalesce(saved["labels"], F.lit(NO_CHOICE))).when(
        skipped.isNotNull(), F.lit(SKIPPED)
    )
    comments = F.when(saved.isNotNull(), F.nullif(py_strip(saved["comments"]), F.lit(""))).when(
        nonblank(skipped["comments"]), skipped["comments"]
    )
    return df.select(*keys, labels.alias("labels"), comments.alias("comments"))


def latest_state(log: DataFrame, order: Sequence[str] = ("ts",), keys: Sequence[str] = STATE_KEYS) -> DataFrame:
    """Current labels and comment per annotator and sample, viewed ones included.

    ``order`` should decide between rows of one key: a time and what breaks its ties, such as a log position. Rows equal in all of it are
    decided by a hash of the row, never by partitioning. The winning save, or else the first skip, is found on fixed-width
    columns alone (``latest``); labels and comments are read once, for the winners, and never sorted. ``state_aggregates`` is the same fold in
    one aggregate, for streams.
    """
    log = log.select(*keys, *[c for c in order if c not in keys], "action", "labels", "comments")
    save, skip = F.col("action") == "save", F.col("action") == "skip"
    # A skip's order is reversed, so the first one is the greatest.
    packs = order_packs(log, order, first=skip)
    named = [f"_pack{i}" for i in range(len(packs))]
    rank = F.when(save, 2).when(skip, 1).otherwise(0)
    packed = log.select("*", rank.alias("_rank"), *[p.alias(n) for p, n in zip(packs, named)])
    # A save beats a skip, and both beat a view, whose order does not matter.
    top = winners(packed.select(*keys, "_rank", *[F.when(F.col("_rank") > 0, F.col(n)).alias(n) for n in named]), keys, ["_rank", *named])
    entry = F.struct("labels", "comments")
    won = matching(packed, top.filter("_rank > 0"), [*keys, "_rank", *named]).select(
        *keys, F.when(F.col("_rank") == 2, entry).alias("_saved"), F.when(F.col("_rank") == 1, entry).alias("_skipped")
    )
    none = F.lit(None).cast(won.schema["_saved"].dataType)
    viewed = top.filter("_rank = 0").select(*keys, none.alias("_saved"), none.alias("_skipped"))
    return unpack_state(won.distinct().unionByName(viewed), keys)


def sheets(samples: DataFrame, state: DataFrame, annotators: Column) -> DataFrame:
    """Every sample once for each given annotator, with labels and comments where they exist.

    ``annotators`` is an array column (a literal list, or ``sequence``): who works on the set is an
    assignment, known beforehand. Sort by ``sample_id`` at the sink.
    """
    assigned = samples.withColumn("annotator_id", F.explode(annotators))
    return assigned.join(state, list(STATE_KEYS), "left")


def ensure_columns(df: DataFrame, row_id: str = "sample_id") -> DataFrame:
    """A loaded sheet with the label and comment columns it may lack."""
    if row_id not in df.columns:
        raise ValueError(f"add {row_id} with sources.row_index before loading the sheet")
    for name in ("labels", "comments"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    return df


def labelled_positions(
    state: DataFrame, positions: DataFrame, resume_compat: bool = False, on: Sequence[str] = ("sample_id",)
) -> DataFrame:
    """``annotator_id, position`` of every labelled sample. ``positions`` numbers the samples from 0, whatever their ids.

    ``resume_compat`` takes the stored text ``None`` as unlabelled, as a reload through a reader with default missing values would.
    """
    done = F.col("labels").isNotNull()
    if resume_compat:
        done = done & (F.col("labels") != NO_CHOICE)
    return _positions_of(state.filter(done).select("annotator_id", *on), positions, on)


def labelled_positions_of_log(log: DataFrame, positions: DataFrame, on: Sequence[str] = ("sample_id",)) -> DataFrame:
    """The same straight from the log: a sample is labelled once it was saved or skipped, whatever came last, so no text is read."""
    touched = log.filter(F.col("action").isin("save", "skip")).select("annotator_id", *on).distinct()
    return _positions_of(touched, positions, on)


def _positions_of(keys: DataFrame, positions: DataFrame, on: Sequence[str]) -> DataFrame:
    return splittable_join(keys, positions.select(*on, "position"), on).select("annotator_id", "position")


def first_gaps(labelled: DataFrame, annotators: DataFrame) -> DataFrame:
    """``annotator_id, first_open, labelled``: the least position that is missing among an annotator's labelled ones, and their number.

    A position is missing if it is not labelled while the one before it is, or if it is 0. So every labelled position also speaks for its successor, and
    the two kinds of rows meet by annotator and position: no annotator's rows meet in one task, none are sorted, and samples without a
    label are never written out.
    """
    marks = F.array(
        F.struct(F.col("position").alias("at"), F.lit(True).alias("own")), F.struct((F.col("position") + 1).alias("at"), F.lit(False).alias("own"))
    )
    spoken = labelled.select("annotator_id", F.inline(marks)).unionByName(
        annotators.select("annotator_id", F.lit(0).cast("bigint").alias("at"), F.lit(False).alias("own"))
    )
    places = spoken.groupBy("annotator_id", "at").agg(F.max("own").alias("own"))
    gaps = places.groupBy("annotator_id").agg(
        F.min(F.when(~F.col("own"), F.col("at"))).alias("first_open"), F.count_if("own").alias("labelled")
    )
    return gaps.join(annotators.select("annotator_id"), "annotator_id", "left_semi")


def _first_open(gaps: DataFrame, total: Column) -> DataFrame:
    """An annotator who is done starts over at 0."""
    return gaps.withColumn("total", total).withColumn("first_open", F.when(F.col("first_open") < F.col("total"), F.col("first_open")).otherwise(0))


def resume_positions(labelled: DataFrame, annotators: DataFrame, total: Column) -> DataFrame:
    """Position of the first unlabelled sample per annotator, 0 when all ``total`` are done.

    ``labelled`` is that of ``labelled_positions``, ``annotators`` has a row for each annotator of the set, ``total`` may be a scalar subquery.
    """
    return _first_open(first_gaps(labelled, annotators), total).select("annotator_id", F.col("first_open").alias("resume_at"))


def progress_by_annotator(labelled: DataFrame, annotators: DataFrame, total: Column) -> DataFrame:
    """Samples, labelled ones, their share, and the share that the position bar shows; arguments as in ``resume_positions``."""
    return _first_open(first_gaps(labelled, annotators), total).select(
        "annotator_id",
        "total",
        "labelled",
        F.try_divide("labelled", "total").alias("labelled_share"),
        F.try_divide(F.col("first_open") + 1, F.col("total")).alias("position_share"),
    )


def resume_position(sheet: DataFrame, resume_compat: bool = False) -> DataFrame:
    """Position of the first unlabelled sample per annotator, 0 when all are done, from a whole sheet (``resume_positions`` needs none).

    ``position`` numbers the sample table from 0 (``sources.row_index``), whatever its ids. ``resume_compat`` also takes the stored text ``None`` as unlabelled, as a reload through a reader with
    default missing values would.
    """
    open_ = F.col("labels").isNull()
    if resume_compat:
        open_ = open_ | (F.col("labels") == NO_CHOICE)
    return sheet.groupBy("annotator_id").agg(
        F.coalesce(F.min(F.when(open_, F.col("position"))), F.lit(0)).alias("resume_at")
    )


def progress(sheet: DataFrame) -> DataFrame:
    """Samples, labelled share, and the share the position bar shows, from the sheet's ``position``."""
    total = F.count(F.lit(1))
    labelled = F.count("labels")
    first_open = F.coalesce(F.min(F.when(F.col("labels").isNull(), F.col("position"))), F.lit(0))
    return sheet.groupBy("annotator_id").agg(
        total.alias("total"),
        labelled.alias("labelled"),
        F.try_divide(labelled, total).alias("labelled_share"),
        F.try_divide(first_open + 1, total).alias("position_share"),
    )


def option_counts(
    state: DataFrame, options: Sequence[str] = ANNOTATION_OPTIONS, keys: Sequence[str] = ()
) -> DataFrame:
    """How often each option was chosen, with zeros; one partial aggregate, no explode."""
    picked = state.select(*keys, chosen_options(F.col("labels")).alias("_picked"))
    rows = [
        F.struct(F.lit(o).alias("option"), F.count_if(F.array_contains("_picked", o)).alias("n")) for o in options
    ]
    return picked.groupBy(*keys).agg(F.array(*rows).alias("_rows")).select(*keys, F.inline("_rows"))

"""The last row per key, without sorting or hashing whole rows.

The winning order key is found first, by hash aggregation over columns of one word each; the rows themselves are read once, as the probe side of a
hash join with the winners. A sort-based aggregate would sort every payload in each task instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits that an order column takes of a word; several narrow ones share it.
_WIDTHS = {T.BooleanType: 2, T.ByteType: 9, T.ShortType: 17, T.IntegerType: 33, T.DateType: 33, T.LongType: 64, T.TimestampType: 64, T.TimestampNTZType: 64}
_WORD = 63


def _word(column: Column, kind: T.DataType) -> Column:
    """A value as a long in the same order; null comes first (and equals the least long, for types that fill one)."""
    if isinstance(kind, T.DateType):
        column = F.unix_date(column)
    elif isinstance(kind, T.TimestampNTZType):
        # A timestamp without zone counts as one in UTC, whatever the session's zone.
        column = F.unix_micros(F.to_utc_timestamp(column.cast("timestamp"), F.current_timezone()))
    elif isinstance(kind, T.TimestampType):
        column = F.unix_micros(column)
    width = _WIDTHS[type(kind)]
    if width == 64:
        return F.coalesce(column.cast("long"), F.lit(-(1 << 63)))
    # From 1 up, with 0 for null.
    offset = 1 if isinstance(kind, T.BooleanType) else (1 << (width - 2)) + 1
    return F.coalesce(column.cast("int").cast("long") + F.lit(offset).cast("long"), F.lit(0).cast("long"))


def order_packs(df: DataFrame, order: Sequence[str], first: Column | None = None) -> list[Column]:
    """Order columns as sortable columns of fixed width, and after them a hash of the whole row.

    Whole numbers, dates and timestamps become longs, narrow ones together. Any other type is a column by itself (and strings make the narrow aggregate
    a sorting one). Where ``first`` holds, order is reversed: the least order key counts as the greatest.
    """
    packs: list[Column] = []
    bits, now = _WORD, None
    for c in order:
        kind = df.schema[c].dataType
        if type(kind) not in _WIDTHS:
            if first is not None:
                raise ValueError(f"order columns must be whole numbers, dates or timestamps, not {kind.simpleString()}")
            packs, bits, now = packs + ([] if now is None else [now]) + [F.col(f"`{c}`")], _WORD, None
            continue
        width, value = _WIDTHS[type(kind)], _word(F.col(f"`{c}`"), kind)
        if now is not None and bits + width <= _WORD:
            bits, now = bits + width, F.shiftleft(now, width) + value
        else:
            packs += [] if now is None else [now]
            bits, now = width, value
    packs += [] if now is None else [now]
    packs.append(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    # The complement turns the order of all longs around, the least one included.
    return packs if first is None else [F.when(first, F.bitwise_not(p)).otherwise(p) for p in packs]


def matching(left: DataFrame, top: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of ``left`` that equal a row of the narrow table ``top`` in the columns ``by``, nulls too.

    All of ``by`` take part in the shuffle, order key included: the rows of one hot key spread over all tasks.
    """
    right = top.select(*[F.col(f"`{c}`").alias(f"_top_{c}") for c in by])
    on = F.lit(True)
    for c in by:
        on = on & F.col(f"`{c}`").eqNullSafe(F.col(f"`_top_{c}`"))
    return left.join(right.hint("shuffle_hash"), on, "left_semi")


def winners(narrow: DataFrame, keys: Sequence[str], packs: Sequence[str]) -> DataFrame:
    """``keys`` and the greatest ``packs`` of each, compared one after the other.

    The greatest first pack of a key combines partially and leaves few rows. Among these, from the last pack to the second, each hash aggregate
    keeps, per value of the packs before, the greatest of its own and what follows it. So a hot key is never gathered.
    """
    head = narrow.groupBy(*keys).agg(F.max(packs[0]).alias(packs[0]))
    top = matching(narrow, head, [*keys, packs[0]])
    for i in range(len(packs) - 1, 0, -1):
        later = [F.max_by(p, packs[i]).alias(p) for p in packs[i + 1 :]]
        top = top.groupBy(*keys, *packs[:i]).agg(F.max(packs[i]).alias("_greatest"), *later).withColumnRenamed("_greatest", packs[i])
    return top.select(*keys, *packs)


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last by ``order``; all columns, null keys included.

    Of rows equal in all order columns the one with the greatest hash counts, so the outcome does not hang on partitions; exact copies are
    one row. The join is on key and order key, so the rows of one key are spread over all tasks, and copies of one row are
    combined before they are shuffled again.
    """
    packs = order_packs(df, order)
    named = [f"_pack{i}" for i in range(len(packs))]
    columns = [F.col(f"`{c}`") for c in df.columns]
    packed = df.select(*columns, *[p.alias(n) for p, n in zip(packs, named)])
    top = winners(packed.select(*keys, *named), keys, named)
    return matching(packed, top, [*keys, *named]).select(*columns).distinct()


def checked_unique(df: DataFrame, key: str, what: str) -> DataFrame:
    """``df``, of which a query fails if ``key`` repeats. Only the key column is read and shuffled for the check."""
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").agg(F.count(F.lit(1)).alias("_repeats")).scalar()
    message = F.lit(f"{what} repeats values of {key}; name the columns whose last row counts with order=[...]")
    return df.filter(F.when(repeated > 0, F.raise_error(message).cast("boolean")).otherwise(True))

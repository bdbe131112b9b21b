"""Equi-joins in a shape that a hot key cannot overload."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def splittable_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    salts: int = 1,
    hot: Sequence[str] | None = None,
) -> DataFrame:
    """Join ``left`` (possibly with hot keys) to ``right`` (few rows per key): left columns, then right ones.

    No broadcast hint: the adaptive planner broadcasts ``right`` once it has measured it to be small. When it
    is large, one key may own a huge share of ``left``, and there are two ways to split it:

    * ``salts=1`` leaves it to AQE's skew join. AQE splits a side only if both sides are read straight from a
      shuffle, which a ``right`` aggregated on the same key is not. Joining on an expression of the key gives
      that side its own shuffle and keeps the split possible.
    * ``salts>1`` spreads each key over that many partitions and copies ``right`` to match. It needs no AQE,
      so it is the choice for streams. The salt mixes row content with the input partition, so exact copies
      are spread too and a retried task gives the same salts. With ``hot``, only these values of the first key (as text) are spread, and
      ``right`` is copied for them alone; ``hot_keys`` finds them.

    Keys are compared as text.
    """
    kept = [c for c in left.columns]
    added = [] if how in ("left_semi", "left_anti") else [c for c in right.columns if c not in on]
    clash = sorted(set(kept) & set(added))
    if clash:
        raise ValueError(f"columns on both sides of the join: {clash}")
    if salts > 1:
        content = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in kept]), F.lit(salts))
        salt, copies = F.pmod(content + F.spark_partition_id(), F.lit(salts)).cast("int"), F.sequence(F.lit(0), F.lit(salts - 1))
        if hot is not None:
            is_hot = F.col(f"`{on[0]}`").cast("string").isin(list(hot))
            salt, copies = F.when(is_hot, salt).otherwise(0), F.when(is_hot, copies).otherwise(F.array(F.lit(0)))
        left, right = left.withColumn("_salt", salt), right.withColumn("_salt", F.explode(copies))
    left, right = left.alias("l"), right.alias("r")
    condition = [
        F.col(f"l.`{k}`").cast("string") == F.concat(F.col(f"r.`{k}`").cast("string"), F.lit("")) for k in on
    ]
    if salts > 1:
        condition.append(F.col("l._salt") == F.col("r._salt"))
    return left.join(right, condition, how).select(
        *[F.col(f"l.`{c}`") for c in kept], *[F.col(f"r.`{c}`") for c in added]
    )


def hot_keys(df: DataFrame, key: str, share: float) -> list[str]:
    """Values of ``key``, as text, that may own at least ``share`` of the rows: at most ``1 / share`` of them, whatever the rows.

    From a frequent-items sketch of fixed size per task, merged over all tasks. Its counts are upper bounds, so no value that owns the share is missed.
    """
    most = math.ceil(1 / share)
    tracked = 1 << max(5, (16 * most).bit_length())
    sketch = F.expr(f"approx_top_k(`_key`, {most}, {tracked})")
    keyed = df.select(F.col(f"`{key}`").cast("string").alias("_key")).filter("_key is not null")
    row = keyed.agg(sketch.alias("top"), F.count(F.lit(1)).alias("n")).head()
    return [t["item"] for t in row["top"] or () if t["count"] >= share * row["n"]]

"""Connected components of a link table, by union-find in tasks and star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agreelens.llm.common import staged


def union_find(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Node -> parent, with every parent path leading to the smallest node of its set."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        path = []
        while (up := parent.setdefault(x, x)) != x:
            path.append(x)
            x = up
        for y in path:
            parent[y] = x
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def local_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one batch after another, each reduced to node -> smallest node known to be linked."""
    for batch in batches:
        pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        links = [(x, up) for x, up in union_find(pairs).items() if x != up]
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["u", "v"])


def fingerprint(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) to ``(node, component)``, the smallest node that can be reached.

    Tasks first shrink their own links to forests. Then large-star and small-star steps alternate until
    nothing changes: each is one partial aggregation and one join, which splits a node with very many
    links. Every step is written to the shared folder, so lineage stays short. No links: no rows.
    """
    steps = staged(links.mapInArrow(local_forests, "u long, v long").distinct(), "components")
    before = fingerprint(steps)
    while before[0]:
        both = steps.union(steps.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        steps = staged(rest.union(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        after = fingerprint(steps)
        if after == before:
            break
        before = after
    return steps.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        steps.select("v", "v").distinct()
    )

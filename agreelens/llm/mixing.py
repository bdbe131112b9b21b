"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks, then seeded selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agreelens.llm.common import WORD, staged


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients votes / (2 k + 1), ties to the earlier entry; exact and linear in the entries.

    At the divisor votes.sum() / seats the rounded shares miss the total by at most half the entries, so
    only the next few quotients of each entry on one side need ranking.
    """
    votes = np.asarray(votes, float)
    total = votes.sum()
    if seats <= 0 or total <= 0:
        return np.zeros(len(votes), np.int64)
    share = votes * (seats / total)
    held = np.floor(share + 0.5).astype(np.int64)
    miss = int(seats - held.sum())
    if not miss:
        return held
    reach = np.ceil((abs(miss) + len(votes)) * votes / total).astype(np.int64) + 1
    who = np.repeat(np.arange(len(votes)), reach)
    step = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
    k = held[who] + step if miss > 0 else held[who] - 1 - step
    ok = (k >= 0) & (votes[who] > 0)
    who, k = who[ok], k[ok]
    quotient = votes[who] / (2 * k + 1)
    order = np.lexsort((who, -quotient)) if miss > 0 else np.lexsort((-who, quotient))
    np.add.at(held, who[order[: abs(miss)]], 1 if miss > 0 else -1)
    return held


def source_targets(sizes: DataFrame, weights: tuple[float, ...], max_repeats: int) -> DataFrame:
    """``source, source_size, n_docs`` per source to its ``weight`` and ``target``.

    Targets share the total by weight and stop at ``max_repeats`` times the source's size; what is over goes to
    the others by weight. In order of size / weight, the capped sources are the first ones, until a source's cap is
    not below its share of what is left; later sources would give smaller shares. One row per source.
    """
    in_order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    t = sizes.withColumn("weight", F.get(cycle, (F.row_number().over(in_order) - 1) % len(weights)))
    t = t.withColumn("cap", F.col("source_size") * float(max_repeats)).withColumn("level", F.col("cap") / F.col("weight"))
    rising = Window.orderBy("level", F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    t = t.withColumn("share", left / weight_left)
    t = t.withColumn("rate", F.max(F.when(F.col("share") <= F.col("level"), F.col("share"))).over(everything))
    target = F.least("cap", F.coalesce(F.col("rate") * F.col("weight"), F.col("cap")))
    return t.select("source", "source_size", "n_docs", "weight", target.alias("target"))


def quotas(parts: DataFrame, keys: list[str], votes: str, seats: str) -> DataFrame:
    """``parts`` with ``blocks``: the seats of each group of ``keys``, given to its rows by their votes."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema) + ", blocks long"

    def apportion(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([c for c in ("source", "shard") if c in group], na_position="last", kind="stable")
        return group.assign(blocks=sainte_lague(group[votes].to_numpy(), int(group[seats].iloc[0])))

    return parts.groupBy(*keys).applyInPandas(apportion, schema)


def with_taken(
    rows: DataFrame, weights: tuple[float, ...], max_repeats: int, block: int, seed: int, shard_docs: int
) -> DataFrame:
    """``rows`` (doc_id, source, size, tie and any more) with source_size, target and taken."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = source_targets(sizes, tuple(weights), max_repeats)
    total = F.sum("source_size").over(Window.partitionBy())
    targets = targets.withColumn("all_blocks", F.floor(total / block + 0.5).cast("long")).withColumn("one", F.lit(0))
    # One row per source.
    targets = quotas(targets, ["one"], "target", "all_blocks").drop("one", "all_blocks", "weight")
    targets = targets.withColumnRenamed("blocks", "source_blocks")
    targets = staged(
        targets.withColumn("shards", F.least(F.ceil(F.col("n_docs") / shard_docs), F.lit(65536)).cast("long")).drop("n_docs"), "mixing-targets"
    )
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = rows.withColumn("place", F.md5(F.concat(F.lit(f"{seed}:"), key)))
    fine = F.conv(F.substring("place", 1, 8), 16, 10).cast("long")
    t = targets.withColumnRenamed("source", "of")
    rows = rows.join(t, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("shard", fine % F.col("shards"))
    shards = rows.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_blocks").alias("source_blocks"))
    # At most 65,536 rows per source.
    shards = quotas(shards, ["source"], "shard_size", "source_blocks")
    words = F.least(F.col("blocks") * block, max_repeats * F.col("shard_size"))
    shards = shards.select(F.col("source").alias("of"), F.col("shard").alias("part"), "shard_size", words.alias("words"))
    rows = rows.join(shards, F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("part")))
    front = Window.partitionBy("of", "part").orderBy("place", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(front), F.lit(0))
    again = F.expr("case when shard_size > 0 then words div shard_size else 0 end")
    extra = F.expr("case when shard_size > 0 then words % shard_size else 0 end")
    rest = F.greatest(F.lit(0), F.least(F.col("size"), extra - start))
    taken = (again * F.col("size") + rest).cast("long")
    return rows.withColumn("taken", taken).drop("of", "part", "place", "shard", "shards", "source_blocks", "shard_size", "words")


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(text_col).alias("tie"),
        *more,
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (1, 2, 3),
    max_repeats: int = 3,
    block: int = 32,
    seed: int = 17,
    shard_docs: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How many words the mix takes from each document: ``doc_id, source, size, source_size, target, taken``.

    Sources by code point, null last, weigh ``weights`` in turn and share the total size; no source is taken
    more than ``max_repeats`` times. The total is cut into blocks of ``block`` words, which go to the sources
    by highest Sainte-Laguë quotients, and each source's blocks to its shards (about ``shard_docs`` documents,
    by id hash) in the same way. Within a shard, documents stand in the order of a seeded hash; the quota takes
    the whole shard as often as it can, and the rest from the front of that order, so one document per shard
    is cut and reruns agree.

    Only sums per shard and source are brought together; a source with a third of all rows is many shards.
    Null and empty texts have size 0 and give 0 words. Null ids and repeated rows are mixed like others (ties
    in order by text hash). Other columns are ignored. An empty table gives an empty result.
    """
    rows = staged(measured(docs, id_col, text_col, source_col), "mixing-sizes")
    out = with_taken(rows, weights, max_repeats, block, seed, shard_docs)
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")


def mix_documents(
    docs: DataFrame,
    weights: tuple[float, ...] = (1, 2, 3),
    max_repeats: int = 3,
    block: int = 32,
    seed: int = 17,
    shard_docs: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mixed corpus itself, in the columns of ``docs``: see ``mix_sources`` for what is taken.

    A document taken whole several times stands in as many rows; one taken in part adds a row with its first
    words, joined by one space. Documents of which nothing is taken, empty ones among them, are left out.
    """
    rows = measured(docs, id_col, text_col, source_col, F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    out = with_taken(rows, weights, max_repeats, block, seed, shard_docs).where("taken > 0")
    copies = F.expr("sequence(1, cast((taken + size - 1) div size as int))")
    out = out.select("row", "size", "taken", F.explode(copies).alias("copy"))
    cut = F.col("copy") * F.col("size") > F.col("taken")
    text = F.col("row").getField(text_col)
    first = F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, (F.col("taken") % F.col("size")).cast("int"))
    columns = [F.col("row").getField(c).alias(c) for c in docs.columns if c != text_col]
    columns.insert(docs.columns.index(text_col), F.when(cut, F.concat_ws(" ", first)).otherwise(text).alias(text_col))
    return out.select(*columns)

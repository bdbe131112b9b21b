"""Near-duplicate documents: SuperMinHash signatures, banding, verification, union-find groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agreelens.llm.common import GOLDEN, WordHashes, id_and_bytes, mix64, staged, window_hashes
from agreelens.llm.components import components

SIGNED = "doc_id long, n_shingles long, set_low long, set_high long, bands array<long>"


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; a shorter text is one run, an empty one has none."""
    if len(words) and len(words) < size:
        return window_hashes(words, len(words)) ^ np.uint64(len(words))
    return np.unique(window_hashes(words, size))


def super_min_hash(elements: np.ndarray, owner: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """``n_docs`` x ``m`` SuperMinHash signatures of the sets given by (element, owner) pairs.

    Every element deals the ranks 0..m-1 to the m places by its own random permutation, and a place keeps
    its least (rank, fraction). Ranks of one element differ in all places, which is what lowers the
    variance. Rank j goes out to all documents at once; a document stops as soon as all its places hold
    ranks up to j, for later ones cannot be smaller.
    """
    if len(elements) > 250_000:  # the signature of a union is the minimum of its parts' signatures
        halves = np.array_split(np.arange(len(elements)), len(elements) // 200_000 + 1)
        return np.minimum.reduce([super_min_hash(elements[h], owner[h], n_docs, m) for h in halves])
    least = np.full(n_docs * m, np.iinfo(np.uint64).max, np.uint64)
    places = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(elements), 1))
    active = np.arange(len(elements))
    for j in range(m):
        if not len(active):
            break
        random = mix64(elements[active] + np.array([j + 1], np.uint64) * GOLDEN)
        k = j + ((random >> np.uint64(32)) % np.uint64(m - j)).astype(np.int64)
        chosen = places[active, k]
        places[active, k] = places[active, j]
        value = (np.uint64(j) << np.uint64(32)) | (random & np.uint64(0xFFFFFFFF))
        np.minimum.at(least, owner[active] * m + chosen, value)
        top = least.reshape(n_docs, m).max(axis=1) >> np.uint64(32)
        active = active[top[owner[active]] > j]
    return least.reshape(n_docs, m)


def signed(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """Per document the size and a 128-bit key of its shingle set, and one key per band."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        salt = mix64(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN)

        def flush(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            sizes = np.array([len(s) for s in sets])
            owner = np.repeat(np.arange(len(sets)), sizes)
            least = super_min_hash(np.concatenate(sets), owner, len(sets), bands * rows)
            keys = np.zeros((len(sets), bands), np.uint64) + salt
            parts = least.reshape(len(sets), bands, rows)
            for r in range(rows):
                keys = mix64(keys * GOLDEN + parts[:, :, r])
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            halves = [np.frombuffer(d, np.int64) if d else (None, None) for d in digests]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([h[0] for h in halves], pa.int64()),
                    pa.array([h[1] for h in halves], pa.int64()),
                    pa.array([k.view(np.int64) if n else None for k, n in zip(keys, sizes)], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "set_low", "set_high", "bands"],
            )

        for batch in batches:
            ids, sets, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc_id)
                sets.append(shingle_set(hashes.of((text or b"").lower().split()), shingle))
                held += len(sets[-1])
                if held > 100_000:
                    yield flush(ids, sets)
                    ids, sets, held = [], [], 0
            if ids:
                yield flush(ids, sets)

    return docs.mapInArrow(sign, SIGNED)


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, shingles``: the full set as sorted 64-bit hashes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out = [
                shingle_set(hashes.of((t or b"").lower().split()), shingle).tobytes() for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "shingles"])

    return docs.mapInArrow(sets, "doc_id long, shingles binary")


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with their overlap ``both``, whether it is ``percent`` of the union, and ``rest``, what b has beyond a."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            overlaps, linked, rests = [], [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                rest = np.setdiff1d(y, x, assume_unique=True)
                both = len(y) - len(rest)
                overlaps.append(both)
                linked.append(100 * both >= percent * (len(x) + len(rest)))
                rests.append(rest.view(np.int64))
            columns = [pa.array(overlaps, pa.int64()), pa.array(linked, pa.bool_()), pa.array(rests, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["a", "b", "both", "linked", "rest"])

    with_b = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    with_both = with_b.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    return with_both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, both long, linked boolean, rest array<long>")


def near_duplicate_groups(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: groups of documents linked by near-equal shingle sets.

    Words are lower-cased in A-Z only. Documents with equal sets become one class. Two classes are compared
    if they share a band key (two sets 80 % alike miss all 32 bands with probability 3e-6), and linked if
    their full sets agree. A bucket of n classes is not compared n x n: all are compared with its smallest
    class, components are formed, and what is left in another component than the bucket's main one is
    compared with the others, unless the two together cannot reach ``percent``: their overlap is at most what
    either shares with the smallest class plus what both have beyond it. After that, every two classes of a bucket
    are in one component, compared, or ruled out.

    Empty and null texts have no shingles and are linked with nothing. Rows without an id come back with
    component_id and kept null. Rows with the same id are grouped each by its own text. Other columns are
    ignored. An empty table gives an empty result. A very long text is one row in a worker, never cut.
    """
    docs = id_and_bytes(docs, id_col, text_col)
    signs = staged(signed(docs, shingle, bands, rows), "near-dedup-signs")
    known = signs.where("doc_id is not null and set_low is not null")
    classes = known.groupBy("set_low", "set_high").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"))
    classes = staged(classes, "near-dedup-classes")
    of_rep = known.join(classes, ["set_low", "set_high"]).where("doc_id = rep").select("rep", "n", "bands")
    buckets = of_rep.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("rep").alias("head"), F.max("rep").alias("last")).where("head < last")
    members = staged(buckets.join(shared.select("bucket", "head"), "bucket").distinct(), "near-dedup-members")

    needed = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = shingle_sets(docs.join(needed, "doc_id", "left_semi"), shingle)
    sets = staged(sets.dropDuplicates(["doc_id", "shingles"]), "near-dedup-sets")
    first = members.where("rep > head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    first = staged(compared(first, sets, percent), "near-dedup-compared")
    links = first.where("linked").select("a", "b")

    groups = components(links)
    placed = members.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    placed = staged(placed.withColumn("component", F.coalesce("component", "rep")), "near-dedup-placed")
    sizes = placed.groupBy("bucket", "component").count()
    main = sizes.groupBy("bucket").agg(F.max_by("component", "count").alias("main"), F.count("*").alias("parts"), F.sum("count").alias("n_members"))
    main = main.where("parts > 1 and n_members > 2").select("bucket", "main")
    # Each member as seen from its bucket's head: what they share, and what the member has beyond it.
    seen = first.select(F.col("a").alias("head"), F.col("b").alias("rep"), "both", "rest")
    open_ = placed.join(main, "bucket").join(seen, ["head", "rep"], "left")
    none = F.array().cast("array<long>")
    open_ = staged(open_.withColumns({"both": F.coalesce("both", "n"), "rest": F.coalesce("rest", none)}), "near-dedup-open")
    left = open_.where("component <> main").select("bucket", *(F.col(c).alias(f"{c}_l") for c in ("rep", "component", "n", "both", "rest")))
    right = open_.select("bucket", (F.col("component") == F.col("main")).alias("in_main"), *(F.col(c).alias(f"{c}_r") for c in ("rep", "component", "n", "both", "rest")))
    # Two members share at most what either shares with the head, and what both have beyond it.
    most = "(least(both_l, both_r) + size(array_intersect(rest_l, rest_r)))"
    fits = f"100 * least(n_l, n_r) >= {percent} * greatest(n_l, n_r) and 100 * {most} >= {percent} * (n_l + n_r - {most})"
    second = left.join(right, "bucket").where(f"component_l <> component_r and (in_main or rep_l < rep_r) and {fits}")
    second = second.select(F.least("rep_l", "rep_r").alias("a"), F.greatest("rep_l", "rep_r").alias("b")).distinct()
    second = second.join(first.select("a", "b"), ["a", "b"], "left_anti")
    more = staged(compared(second, sets, percent).where("linked").select("a", "b"), "near-dedup-links")
    if not more.isEmpty():
        groups = components(links.union(more))

    of_class = classes.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select("set_low", "set_high", F.coalesce("component", "rep").alias("component"))
    out = signs.join(of_class, ["set_low", "set_high"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))

"""Exact top-k by inner product: a Voronoi join of queries and data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agreelens.llm.common import staged

CELL = "vec_id long, v array<double>, is_query boolean, cell int, distance double"


def floored(vectors: DataFrame, id_col: str, vector_col: str, scale: float, query_every: int) -> DataFrame:
    """Usable vectors with components floor(scale * x); ``is_query`` marks ids divisible by ``query_every``."""
    v = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("raw"), v.alias("v"))
    fine = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("raw").isNotNull() & (F.size("raw") > 0) & fine & F.col("vec_id").isNotNull())
    return rows.select("vec_id", "v", (F.col("vec_id") % query_every == 0).alias("is_query"))


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point as long as that is exact."""
    largest = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if largest < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def exact_top_k(
    vectors: DataFrame,
    k: int = 5,
    query_every: int = 50,
    scale: float = 256.0,
    pivots: int = 64,
    block_rows: int = 4096,
    seed: int = 17,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """For every vector whose id is divisible by ``query_every``, the ``k`` others with the highest inner product.

    Voronoi join: ``pivots`` vectors, the first by seeded hash, split data and queries into cells of the nearest pivot.
    A cell's summary is its row count, radius and largest norm. A query first searches the blocks of its home cell, which
    gives it a floor: its k-th best score there. Another cell is searched only if the bound
    q.p + |q| radius (or |q| norm, if smaller) reaches that floor, so what is left out cannot be in the answer. Cells are cut into
    blocks of about ``block_rows`` rows by id hash, queries of a cell likewise, and each pair of blocks is solved in
    one task; the best k of every block are merged by rank. A hot cell is therefore many tasks.

    Returns ``query_id, rank, vec_id, score`` with fewer rows for a query if fewer candidates exist; ties go to the
    smaller id. Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without an
    id. A query's own row and rows with its id are no candidates; other repeated rows each count. Vectors
    must have one length. Other columns are ignored. An empty table gives an empty result.
    """
    rows = floored(vectors, id_col, vector_col, scale, query_every)
    # At most ``pivots`` vectors.
    chosen = rows.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(pivots).select("v").collect()
    out_schema = "query_id long, rank int, vec_id long, score long"
    if not chosen:
        return vectors.sparkSession.createDataFrame([], out_schema)
    centres = np.unique(np.array([r["v"] for r in chosen]), axis=0)

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (centres**2).sum(axis=1) / 2
        for batch in batches:
            if batch.num_rows:
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                cell = np.argmin(half - v @ centres.T, axis=1)
                distance = np.sqrt(((v - centres[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell, pa.int32()), pa.array(distance)], ["vec_id", "v", "is_query", "cell", "distance"]
                )

    placed = staged(rows.mapInArrow(to_cells, CELL), "knn-cells")
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    summary = placed.groupBy("cell").agg(
        F.count("*").alias("n"),
        F.sum(F.col("is_query").cast("long")).alias("queries"),
        F.max("distance").alias("radius"),
        F.sqrt(F.max(squares)).alias("norm"),
    )
    cells = {r["cell"]: r for r in summary.collect()}  # at most ``pivots`` rows
    numbers = np.array(sorted(cells))
    radius, norm = (np.array([cells[c][f] for c in numbers]) for f in ("radius", "norm"))
    parts = {int(c): -(-cells[c]["n"] // block_rows) for c in numbers}
    of_cell = F.create_map(*(x for c, n in parts.items() for x in (F.lit(c), F.lit(n))))
    block = F.pmod(F.xxhash64("vec_id"), F.element_at(of_cell, F.col("cell"))).cast("int")
    data = placed.select("cell", block.alias("block"), "vec_id", "v")

    def search(queries: DataFrame) -> DataFrame:
        """``queries`` (query_id, q, cell to search) to the best k of every block of that cell."""
        # Queries of one target cell are dealt to groups, each of which meets every block of the cell.
        sizes = queries.groupBy("cell").count().collect()  # at most ``pivots`` rows
        groups = {int(r["cell"]): -(-r["count"] // block_rows) for r in sizes}
        if not groups:
            return None
        of_query = F.create_map(*(x for c, n in groups.items() for x in (F.lit(c), F.lit(n))))
        n_groups = F.element_at(of_query, F.col("cell"))
        left = queries.withColumn("part", F.pmod(F.xxhash64("query_id"), n_groups).cast("int"))
        left = left.withColumn("block", F.explode(F.sequence(F.lit(0), (F.element_at(of_cell, F.col("cell")) - 1).cast("int"))))
        right = data.where(F.col("cell").isin(list(groups)))
        right = right.withColumn("part", F.explode(F.sequence(F.lit(0), (n_groups - 1).cast("int"))))

        def solve(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
            ids, x = b["vec_id"].to_numpy(), np.stack(b["v"].to_numpy())
            own, q = a["query_id"].to_numpy(), np.stack(a["q"].to_numpy())
            found = []
            for at in range(0, len(own), 512):
                scores = inner_products(q[at : at + 512], x)
                for query, line in zip(own[at : at + 512], scores):
                    usable = ids != query
                    if usable.sum() > 4 * k:  # all that tie with the k-th best stay
                        usable &= line >= np.partition(line[usable], -k)[-k]
                    near = np.flatnonzero(usable)
                    near = near[best(ids[near], line[near], k)]
                    found.append((np.full(len(near), query), ids[near], line[near]))
            columns = [np.concatenate(c) for c in zip(*found)]
            return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)))

        keys = ["cell", "block", "part"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(solve, "query_id long, vec_id long, score long")

    queries = placed.where("is_query").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "cell")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    home = search(queries)
    if home is None:
        return vectors.sparkSession.createDataFrame([], out_schema)
    home = staged(home.withColumn("rank", rank).where(F.col("rank") <= k), "knn-home")
    floors = home.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))

    def targets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = centres[numbers]
        for batch in batches:
            if len(batch):
                q = np.stack(batch["q"].to_numpy())
                length = np.sqrt((q**2).sum(axis=1))[:, None]
                bound = np.minimum(q @ at.T + length * radius, length * norm)
                # A hair above the bound covers rounding.
                bound += 1e-9 * (length * norm + 1)
                floor = batch["floor"].fillna(-np.inf).to_numpy(dtype=float)[:, None]
                need = (bound >= floor) & (numbers != batch["cell"].to_numpy()[:, None])
                row, column = np.nonzero(need)
                picked = batch.iloc[row]
                yield pd.DataFrame({"query_id": picked["query_id"].to_numpy(), "q": picked["q"].to_numpy(), "cell": numbers[column]})

    wider = queries.join(floors, "query_id", "left").mapInPandas(targets, "query_id long, q array<double>, cell int")
    away = search(staged(wider, "knn-queries"))
    found = home.drop("rank")
    found = found.union(away) if away is not None else found
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

"""Approximate nearest neighbours by collision counting (operator 3).

Vectors are dealt into blocks; each block is an index of ``PROJECTIONS`` random projections, each a sorted
array of the block's projected vectors.  A query's window on a projection is centred on the query's own
projection; a vector inside it collides.  Windows of radius R are
``WIDTH`` * R to both sides, and virtual rehashing widens R step by step on the same arrays.  A vector that collides
on ``THRESHOLD`` of the projections is verified: its inner product is taken in double precision from the
original vectors.  The search of a block ends when the k-th best verified vector is
within R of the query, or everything is verified.  The best k of all blocks remain.

The largest inner product is the nearest neighbour after each vector x is scaled by the block's largest norm M and gets
one more coordinate, sqrt(1 - |x|^2 / M^2): the squared distance to q / |q| is 2 - 2 <q, x> / (|q| M).

Positions in the sorted arrays are kept as ranks, so that a window is a range of ranks and counting is one comparison
for each vector and projection.

Defined cases: vectors that are null, empty or zero or hold null or non-finite components take no part, nor do rows
without an id; vectors are compared with those of as many components; rows with the query's id are its own and no
candidates; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerbank.llm.common import shuffle_partitions, table

PROJECTIONS = 64
WIDTH = 1.5
#: Share of projections: a vector at distance R collides on 0.866 of them on average, with deviation 0.043.
THRESHOLD = 0.81
#: Factor of virtual rehashing and the first radius.
STEP, FIRST_RADIUS, LAST_RADIUS = 1.12, 0.3, 2.6
#: Rows of a block and queries of a group: at most (ranks have 16 bits), and as many as pay for an index.
MOST_ROWS, LEAST_ROWS, MOST_QUERIES = 1 << 16, 1 << 13, 1 << 14


class CollisionIndex:
    """The sorted arrays of one block of vectors (rows x dimension, float64 or float32)."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, seed: int = 7):
        n, dim = vectors.shape
        self.vectors, self.ids = vectors.astype(np.float64), ids
        norms = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors))
        self.largest = float(norms.max())
        scaled = self.vectors / self.largest
        rest = np.sqrt(np.maximum(0.0, 1.0 - np.square(norms / self.largest)))
        self.axes = np.random.default_rng(seed + dim).standard_normal((PROJECTIONS, dim + 1))
        projected = self.axes[:, :dim] @ scaled.T + np.outer(self.axes[:, dim], rest)
        order = np.argsort(projected, axis=1, kind="stable")
        self.arrays = np.take_along_axis(projected, order, axis=1)
        self.ranks = np.empty((PROJECTIONS, n), dtype=np.uint16)
        np.put_along_axis(self.ranks, order, np.arange(n, dtype=np.uint16)[None, :], axis=1)
        self.level = 0  # where the last search ended; the next begins a step before

    def collisions(self, centre: np.ndarray, radius: float) -> np.ndarray:
        """On how many projections each vector lies in the query-centred window."""
        low = np.array([np.searchsorted(a, c - WIDTH * radius, "left") for a, c in zip(self.arrays, centre)])
        high = np.array([np.searchsorted(a, c + WIDTH * radius, "right") for a, c in zip(self.arrays, centre)])
        some = high > low
        low, last = low[some].astype(np.uint16), (high[some] - low[some] - 1).astype(np.uint16)
        ranks = self.ranks if some.all() else self.ranks[some]
        # Unsigned: ranks under the window wrap round to large numbers.
        return ((ranks - low[:, None]) <= last[:, None]).sum(axis=0, dtype=np.uint8 if PROJECTIONS < 256 else np.uint16)

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the best ``k`` found, best first."""
        query = query.astype(np.float64)
        size = float(np.sqrt(query @ query))
        centre = self.axes[:, :-1] @ (query / size)
        verified = self.ids == own
        rows, values = np.zeros(0, np.int64), np.zeros(0)
        level = max(0, self.level - 1)
        while True:
            radius = FIRST_RADIUS * STEP**level
            if radius <= LAST_RADIUS:
                found = np.flatnonzero((self.collisions(centre, radius) >= THRESHOLD * PROJECTIONS) & ~verified)
            else:  # an exact end: whatever is left
                found = np.flatnonzero(~verified)
            verified[found] = True
            rows = np.concatenate((rows, found))
            values = np.concatenate((values, self.vectors[found] @ query))
            if len(values) > k:
                bound = np.partition(values, -k)[-k]
                kept = values >= bound  # ties stay
                rows, values = rows[kept], values[kept]
            if radius > LAST_RADIUS or verified.all():
                break
            if len(values) >= k:
                distance = math.sqrt(max(0.0, 2.0 - 2.0 * float(values.min()) / (size * self.largest)))
                if distance <= radius:
                    break
            level += 1
        self.level = level
        best = np.lexsort((self.ids[rows], -values))[:k]
        return self.ids[rows[best]], values[best]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows that take part: ``id`` (long), ``vector`` and ``dim``."""
    vector = F.col("vector")
    good = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    found = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    found = found.filter(F.col("id").isNotNull() & (F.size(vector) > 0) & good & F.exists(vector, lambda x: x != 0))
    return found.withColumn("dim", F.size(vector))


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = pa.concat_arrays([chunk.flatten() for chunk in column.chunks]) if column.num_chunks else pa.array([], pa.float32())
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def search_cell(key: tuple, rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The best ``k`` rows of one block for each query of one group."""
    dim = key[0].as_py()
    asked, found, scores = [], [], []
    if rows.num_rows and queries.num_rows:
        index = CollisionIndex(matrix(rows["vector"], dim), rows["id"].to_numpy())
        for own, query in zip(queries["id"].to_numpy(), matrix(queries["vector"], dim)):
            ids, values = index.search(query, int(own), k)
            asked.append(np.full(len(ids), own))
            found.append(ids)
            scores.append(values)
    join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
    return pa.table({"query_id": join(asked, pa.int64()), "vec_id": join(found, pa.int64()), "score": join(scores, pa.float64())})


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of ``vectors`` with the largest inner product for each query."""
    spark = vectors.sparkSession
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    n_rows, n_queries = rows.count(), asked.count()
    blocks = max(1, math.ceil(n_rows / MOST_ROWS * 1.25), min(shuffle_partitions(spark), math.ceil(n_rows / LEAST_ROWS)))
    groups = max(1, math.ceil(n_queries / MOST_QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = rows.withColumns({"block": F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), "group": every(groups)})
    asked = asked.withColumns({"group": F.pmod(F.xxhash64("id", F.lit("q")), F.lit(groups)).cast("int"), "block": every(blocks)})
    cell = ["dim", "block", "group"]
    found = (
        rows.groupBy(*cell)
        .cogroup(asked.groupBy(*cell))
        .applyInArrow(lambda key, x, y: search_cell(key, x, y, k), "query_id long, vec_id long, score double")
    )
    best_first = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest_embeddings(spark, sf_dir: str) -> DataFrame:
    """Query op3: the 20 nearest rows of every embedding whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), 20)

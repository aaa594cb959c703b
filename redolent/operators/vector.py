"""Exact vector search: dot products of unit vectors, one query as a built-in expression, many as blocked matrix products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redolent.session import slots

#: Query vectors and vectors of a block that one task joins, and vectors it multiplies at a time (BLOCK x PART x 8 bytes).
BLOCK, POOL, PART = 4096, 200_000, 2048


def dot(a: Column, b: Column) -> Column:
    """Dot product of two float arrays, summed in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def semantic(distance: Column) -> Column:
    """A cosine distance as a score, 0 at least."""
    return F.greatest(F.lit(0.0), 1 - distance)


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", column: str = "embedding", where: Column | None = None) -> DataFrame:
    """(key, distance): the k nearest of one query among those that pass the filter, which is applied before."""
    pool = vectors if where is None else vectors.where(where)
    distance = 1 - dot(F.col(column), F.array(*[F.lit(float(x)) for x in query]))
    return pool.select(key, distance.alias("distance")).orderBy("distance", key).limit(k)


def _best(ids: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of each row, ties by id."""
    order = np.lexsort((ids, -near), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    lists = table.column(column).combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def nearest_batch(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding", include_self: bool = False) -> DataFrame:
    """(query_id, key, distance, rank): the k nearest of every query among all vectors, exactly.

    queries: (query_id, embedding). Both sides are dealt into blocks by hash, at most about BLOCK queries and POOL vectors each;
    every block of queries meets every block of vectors in a task of its own, as a matrix product in parts of PART vectors,
    which keeps k rows for each query; only those are ranked. No vector comes to the driver. Null and empty vectors are
    skipped; empty tables give no rows.
    """
    pool = vectors.where(F.size(column) > 0).select(F.col(key).cast("long").alias(key), column)
    asked = queries.where(F.size(column) > 0).select(F.col("query_id").cast("long").alias("query_id"), F.col(column).alias("_q"))
    q_blocks = max(1, -(-asked.count() // BLOCK))
    v_blocks = max(slots(vectors.sparkSession) // q_blocks, 1, -(-pool.count() // POOL))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("query_id", "_q", of("query_id", q_blocks).alias("_qb")).withColumn("_vb", every(v_blocks))
    right = pool.select(key, column, of(key, v_blocks).alias("_vb")).withColumn("_qb", every(q_blocks))

    def score(l: pa.Table, r: pa.Table) -> pa.Table:  # noqa: E741
        if not l.num_rows or not r.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), key: pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        names, q = l.column("query_id").to_numpy(), _matrix(l, "_q")
        ids, near = np.zeros((len(names), 0), dtype=np.int64), np.zeros((len(names), 0))
        for at in range(0, r.num_rows, PART):
            part = r.slice(at, PART)
            own = part.column(key).to_numpy()
            dots = q @ _matrix(part, column).T
            if not include_self:
                dots[names[:, None] == own[None, :]] = -np.inf
            ids, near = _best(np.concatenate([ids, np.broadcast_to(own, dots.shape)], axis=1), np.concatenate([near, dots], axis=1), k)
        ok = np.isfinite(near)
        return pa.table({"query_id": np.repeat(names, ok.sum(axis=1)), key: ids[ok], "distance": 1 - near[ok]})

    found = left.groupBy("_qb", "_vb").cogroup(right.groupBy("_qb", "_vb")).applyInArrow(score, f"query_id long, {key} long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)

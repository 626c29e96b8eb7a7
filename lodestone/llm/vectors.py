"""What the two vector searches share: valid vectors as matrices, query blocks, partial lists and their merging."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

#: Queries that the driver holds and sends out at once: of 64 dimensions, 8 MB.
QUERY_BLOCK = 16_384
#: Lists of one query that one merging step takes.
FAN_IN = 64


def finite(col: str) -> Column:
    """True where a vector and all its components are there and finite."""
    return F.col(col).isNotNull() & (F.size(col) > 0) & F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and vector of the rows whose vectors take part."""
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vector")).filter(F.coalesce(finite("vector"), F.lit(False)) & F.col("vec_id").isNotNull())


def matrices(ids: pa.Array, vectors: pa.Array):
    """(positions, ids, matrix of doubles), one for each dimension that occurs."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors, ids = vectors.combine_chunks(), ids.combine_chunks()
    offsets = vectors.offsets.to_numpy()
    dims = np.diff(offsets)
    flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        yield at, ids[at], flat[offsets[at][:, None] + np.arange(d)]


def blocks(queries: DataFrame, most: int = QUERY_BLOCK):
    """The query set in blocks of about ``most`` rows, each collected when it is its turn: lists of (numbers, ids, matrix)."""
    n = queries.count()
    count = -(-n // most) if n else 0
    for b in range(count):
        part = queries if count == 1 else queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(count)) == b)
        got = part.orderBy("vec_id").toArrow()
        if got.num_rows:
            yield list(matrices(got.column("vec_id"), got.column("vector")))


def best(score: np.ndarray, ids: np.ndarray, k: int):
    """Rows and columns of each row's k highest scores, all ties of the k-th included."""
    if score.shape[1] > k:
        least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        return np.nonzero(score >= least[:, None])
    return np.nonzero(score > -np.inf)


class Lists:
    """One task's k best per query so far: by the higher score, ties by the smaller id."""

    def __init__(self, queries: int, k: int, kind):
        self.k, self.rows = k, np.zeros(0, np.int64)
        self.score, self.ids = np.zeros(0, kind), np.zeros(0, np.int64)

    def add(self, rows, score, ids) -> None:
        rows, score, ids = np.concatenate([self.rows, rows]), np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        by = np.lexsort((ids, -score, rows))
        rows, score, ids = rows[by], score[by], ids[by]
        first = np.searchsorted(rows, rows)
        keep = np.arange(len(rows)) - first < self.k
        self.rows, self.score, self.ids = rows[keep], score[keep], ids[keep]


def merge(partial: DataFrame, parts: int, k: int, order: list[Column]) -> DataFrame:
    """Merge per-task lists (query, query_id, vec_id, score, part) in a tree of fan-in FAN_IN; adds ``rank`` from 1."""
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        group = Window.partitionBy("query", "part").orderBy(*order)
        partial = partial.withColumn("part", F.pmod("part", F.lit(parts))).withColumn("rank", F.row_number().over(group)).filter(F.col("rank") <= k).drop("rank")
    last = Window.partitionBy("query").orderBy(*order)
    return partial.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def all_blocks(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    """The blocks' results as one; with many blocks each is written as it is made."""
    if len(parts) > 1:
        parts = [keep(p, "search") for p in parts]
    return functools.reduce(DataFrame.unionByName, parts, empty) if not parts else functools.reduce(DataFrame.unionByName, parts)

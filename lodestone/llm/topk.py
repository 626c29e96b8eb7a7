"""Exact top-k search: tiled matrix products of queries and shards, partial selection, tree merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .vectors import Lists, all_blocks, best, blocks, matrices, merge, valid

#: A tile of scores has so many queries and candidates: 16 MB of doubles.
TILE_QUERIES, TILE_ROWS = 512, 4096
#: Sums of products below this are exact in doubles.
EXACT = float(1 << 53)


def grid(matrix: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * matrix)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of integers held in doubles; exact integers also where doubles are too short, clamped to 64 bits."""
    if q.shape[1] * max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(c).max(initial=0)) < EXACT:
        return (q @ c.T).astype(np.int64)
    big = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in c], object).T
    return np.clip(big, -(1 << 63) + 1, (1 << 63) - 1).astype(np.int64)


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per query the k rows of ``vectors`` with the highest integer inner product of floor(scale * x): query_id, rank, vec_id, score.

    Queries are taken in blocks of bounded size; each task multiplies tiles of its rows with tiles of the block
    and keeps k entries per query; the tasks' lists are merged in a tree.

    Defined cases: vectors that are null, empty or hold null or non-finite components, and rows with a null id,
    take no part; rows with the query's id are its own and no candidates; a vector of another dimension than the
    query's is no candidate; of equal scores the smaller id is better, and equal rows fill several ranks; a query
    given twice is answered twice; empty tables give an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = valid(vectors, id_col, vec_col)
    schema = "query long, query_id long, vec_id long, score long, part int"
    parts, found, first = rows.rdd.getNumPartitions(), [], 0

    for block in blocks(valid(queries, id_col, vec_col)):
        asked = spark.sparkContext.broadcast([(first + at, ids, grid(m, scale)) for at, ids, m in block])
        first += sum(len(at) for at, _, _ in block)

        def search(batches, asked=asked):
            from pyspark import TaskContext

            part, tops = TaskContext.get().partitionId(), [Lists(len(ids), k, np.int64) for _, ids, _ in asked.value]

            def tile(held):
                table = pa.Table.from_batches(held)
                for _, ids, m in matrices(table.column("vec_id"), table.column("vector")):
                    m = grid(m, scale)
                    for top, (_, own, q) in zip(tops, asked.value):
                        if q.shape[1] != m.shape[1]:
                            continue
                        for a in range(0, len(own), TILE_QUERIES):
                            score = products(q[a : a + TILE_QUERIES], m)
                            free = own[a : a + TILE_QUERIES, None] != ids
                            r, c = best(np.where(free, score, np.iinfo(np.int64).min), ids, k)
                            ok = free[r, c]
                            r, c = r[ok], c[ok]
                            top.add(a + r, score[r, c], ids[c])

            held, n = [], 0
            for batch in batches:
                held, n = [*held, batch], n + batch.num_rows
                if n >= TILE_ROWS:
                    tile(held)
                    held, n = [], 0
            if n:
                tile(held)
            for top, (number, own, _) in zip(tops, asked.value):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (number[top.rows], own[top.rows], top.ids, top.score)] + [pa.array(np.full(len(top.rows), part, np.int32))], names=["query", "query_id", "vec_id", "score", "part"])

        partial = rows.mapInArrow(tidy(search), schema)
        found.append(merge(partial, parts, k, [F.desc("score"), F.asc("vec_id")]))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return all_blocks(found, empty)

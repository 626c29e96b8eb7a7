"""Exact nearest neighbours by cosine distance."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import matrices, vectors


def knn(rows: DataFrame, query, k: int, id_col: str = "chunk_id", vec_col: str = "embedding") -> DataFrame:
    """(id, distance) of the ``k`` rows nearest to one vector: smaller distance first, ties by id.

    Filters belong before this call: they then reach the scan, and the limit counts what passes them.
    Runs as one pass with a bounded heap per task.
    """
    distance = vectors.cosine_distance(F.col(vec_col), vectors.literal(query))
    return rows.select(F.col(id_col), distance.alias("distance")).orderBy("distance", id_col).limit(k)


def knn_of_row(rows: DataFrame, key, k: int, id_col: str, vec_col: str = "embedding", stored: DataFrame | None = None) -> DataFrame:
    """The same with a stored vector as the query, taken from ``stored`` or the rows themselves; its row takes part if it is among them. One row is broadcast."""
    query = (rows if stored is None else stored).filter(F.col(id_col) == key).select(F.col(vec_col).alias("_q")).limit(1)
    distance = vectors.cosine_distance(F.col(vec_col), F.col("_q"))
    return rows.join(F.broadcast(query)).select(F.col(id_col), distance.alias("distance")).orderBy("distance", id_col).limit(k)


#: Query vectors of one block: of 768 floats, 12 MB. One block is broadcast; of more, each meets the rows in WAYS parts.
QUERY_ROWS, WAYS = 4096, 64


def scores(queries: DataFrame, rows: DataFrame, query_id: str, id_col: str, vec_col: str = "embedding") -> DataFrame:
    """Similarity matrix (query_id, id, score) of a stated query set against all rows, block by block of the queries."""
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    q = queries.select(F.col(query_id).alias("query_id"), F.col(vec_col).alias("_q"))
    r = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("_v"))
    if blocks == 1:
        met = r.crossJoin(F.broadcast(q))  # at most QUERY_ROWS rows
    else:
        q = q.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("_way", F.explode(F.array(*map(F.lit, range(WAYS)))))
        r = r.withColumn("_way", F.pmod(F.xxhash64("id"), F.lit(WAYS)).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        met = r.join(q, ["_block", "_way"])
    return met.select("query_id", "id", vectors.dot("_q", "_v").alias("score"))


def top_ids(scored: DataFrame, k: int = 10, exclude_self: bool = True) -> DataFrame:
    """Per query the ``k`` best (query_id, id, rank): score descending, ties by id; a query's own row goes before the cut."""
    rows = scored.filter("query_id <> id") if exclude_self else scored
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


#: Components of the vectors that one task holds of a side at a time: of 64, 32,768 vectors, 16 MB of doubles.
CELLS = 1 << 21


def _met(queries: DataFrame, rows: DataFrame, query_id: str, id_col: str, vec_col: str):
    """Both sides as (block, way, id, vector), cogrouped: every block of queries meets every part of the rows once, in groups of bounded size."""
    q = queries.select(F.col(query_id).alias("id"), F.col(vec_col).alias("v")).filter("id is not null")
    r = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).filter("id is not null")
    sized = [F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))]
    asked, held = q.agg(*sized).first(), r.agg(*sized).first()
    most = max(1, CELLS // max(1, asked[1], held[1]))
    blocks = max(1, math.ceil(asked[0] / most))
    ways = max(2 * rows.sparkSession.sparkContext.defaultParallelism, math.ceil(held[0] / most))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.select(part(blocks).alias("block"), every(ways).alias("way"), "id", "v")
    r = r.select(every(blocks).alias("block"), part(ways).alias("way"), "id", "v")
    return q.groupBy("block", "way").cogroup(r.groupBy("block", "way"))


def nearest(queries: DataFrame, rows: DataFrame, k: int, query_id: str, id_col: str, vec_col: str = "embedding", digits: int | None = None) -> DataFrame:
    """Per query the ``k`` rows of the greatest inner product, its own left out: (query_id, id, score, rank).

    Exact: tasks multiply tiles of queries and rows, and keep ``k`` rows of each query; no pair leaves a task otherwise. Scores
    are compared as rounded to ``digits``, halves away from zero; ties go to the smaller id. Null vectors and
    components, and vectors of another size than the query's, have a null score and come last; rows without an id are left out.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    asked = queries.schema[query_id].dataType.simpleString()

    def search(q, r):
        return matrices.nearest(q, r, k, digits)

    parts = _met(queries, rows, query_id, id_col, vec_col).applyInArrow(search, f"query_id {asked}, id {kind}, score double, rounded double")
    order = Window.partitionBy("query_id").orderBy(F.desc("rounded"), F.asc("id"))
    return parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def pair_summary(queries: DataFrame, rows: DataFrame, query_id: str, id_col: str, vec_col: str = "embedding") -> DataFrame:
    """One row: number of all pairs of a query and another row, and the sum and the maximum of their inner products (pairs, scored, total, greatest).

    ``scored`` counts pairs with a score. Tasks multiply tiles and pass on one row for each group.
    """
    parts = _met(queries, rows, query_id, id_col, vec_col).applyInArrow(matrices.summary, "pairs long, scored long, total double, greatest double")
    return parts.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("scored"), F.lit(0)).alias("scored"), F.sum("total").alias("total"), F.max("greatest").alias("greatest"))

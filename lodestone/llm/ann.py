"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. The index holds, for each tile of rows, an inverted file
per pivot: the rows that have the pivot among their nearest, each with the pivot's place in its order. A query
walks the inverted files of its few nearest pivots only, and sums up for every row met how much nearer
the orders are than if the row had none of these pivots; that ranks a tile's rows by the footrule distance
over the query's pivots (a missing pivot stands behind the last place). The best rows are then ranked by true distance.
Pivots come from a bounded sample, for each dimension its own; every row is indexed. Rows of a dimension that the sample
missed have no order, and are all ranked by true distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, tidy
from .vectors import Lists, all_blocks, blocks, matrices, merge, valid

#: Pivots, places kept of a row's order, nearest pivots whose files a query walks: a sixteenth of all files.
PIVOTS, PLACES, WALKED = 1024, 128, 64
#: Rows of a tile, and the part of a tile's rows that is ranked by true distance, with the least number of these.
TILE_ROWS, DEPTH, LEAST = 8192, 0.1, 128
#: Rows looked at for each pivot that is chosen; rows whose orders are worked out together.
LOOKED_AT, TOGETHER = 8, 2048

INDEX = "dim int, ids binary, vectors binary, starts binary, rows binary, places binary"


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)


def orders(m: np.ndarray, pivots: np.ndarray, places: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first, ties by the pivot's number."""
    kept, out = min(places, len(pivots)), np.zeros((len(m), min(places, len(pivots))), np.int64)
    for a in range(0, len(m) if kept else 0, TOGETHER):
        far = squares(m[a : a + TOGETHER], pivots)
        near = np.sort(np.argpartition(far, kept - 1, axis=1)[:, :kept], axis=1)
        out[a : a + TOGETHER] = np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1)
    return out


def choose_pivots(rows: DataFrame, pivots: int, draw: int = 0) -> dict[int, np.ndarray]:
    """For each dimension distinct vectors from the sampled rows, those with the smallest id hashes; another ``draw``, other pivots."""
    got = rows.orderBy(F.xxhash64(F.lit(draw), "vec_id"), "vec_id").limit(LOOKED_AT * pivots).toArrow()
    chosen = {}
    for _, _, m in matrices(got.column("vec_id"), got.column("vector")) if got.num_rows else ():
        _, first = np.unique(m, axis=0, return_index=True)
        chosen[m.shape[1]] = m[np.sort(first)[:pivots]]
    return chosen


def build_index(rows: DataFrame, chosen: dict[int, np.ndarray], places: int = PLACES) -> DataFrame:
    """The index of all rows (vec_id, vector) as a table of tiles, written to the shared folder."""
    sent = rows.sparkSession.sparkContext.broadcast(chosen)
    names = [f.split()[0] for f in INDEX.split(", ")]

    def post(batches):
        def tile(held):
            table = pa.Table.from_batches(held)
            for _, ids, m in matrices(table.column("vec_id"), table.column("vector")):
                pivots = sent.value.get(m.shape[1], np.zeros((0, m.shape[1])))
                flat = orders(m, pivots, places).ravel()
                by = np.argsort(flat.astype(np.uint16 if len(pivots) <= 1 << 16 else np.int64), kind="stable")
                starts = np.searchsorted(flat[by], np.arange(len(pivots) + 1)).astype(np.int32)
                kept = max(1, min(places, len(pivots)))
                raw = (ids, m, starts, (by // kept).astype(np.int32), (by % kept).astype(np.uint16))
                yield pa.RecordBatch.from_arrays([pa.array([m.shape[1]], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in raw]], names=names)

        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= TILE_ROWS:
                yield from tile(held)
                held, n = [], 0
        if n:
            yield from tile(held)

    return keep(rows.mapInArrow(tidy(post), INDEX), "permutation-index")


def footrule(near: np.ndarray, starts, rows, places_of, n: int, places: int) -> np.ndarray:
    """Footrule distances of a query's order ``near``, over the pivots it names, to all rows of a tile.

    Orders of rows keep ``places`` places. A pivot that is at place a of the query's order adds places - a for a row that does
    not have it, and the distance of the places for a row that has.
    """
    a = np.arange(len(near))
    missing = places - a
    gain = (missing[:, None] - np.abs(a[:, None] - np.arange(places))).astype(np.float64)
    spans = [slice(starts[p], starts[p + 1]) for p in near.tolist()]
    met = np.bincount(np.concatenate([rows[s] for s in spans]), np.concatenate([g[places_of[s]] for g, s in zip(gain, spans)]), n)
    return missing.sum() - met.astype(np.int64)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, pivots: int = PIVOTS, places: int = PLACES, walked: int = WALKED, depth: float = DEPTH, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per query the k nearest rows found, by Euclidean distance in double precision: query_id, rank, vec_id, score.

    Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id, take no
    part; a vector of another dimension than the query's is no candidate; rows with the query's id are its own and no
    candidates; of equal distances the smaller id is nearer, and equal rows fill several ranks; a query given
    twice is answered twice; empty tables give an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    nonzero = F.exists("vector", lambda x: x != 0)
    rows = valid(vectors, id_col, vec_col).filter(nonzero)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    chosen = choose_pivots(rows, pivots)
    if not chosen:
        return empty
    index = build_index(rows, chosen, places)
    parts, found, first = index.rdd.getNumPartitions(), [], 0
    for block in blocks(valid(queries, id_col, vec_col).filter(nonzero)):
        mine = [(first + at, ids, m, orders(m, chosen.get(m.shape[1], np.zeros((0, m.shape[1]))), walked)) for at, ids, m in block]
        first += sum(len(at) for at, _, _ in block)
        asked = spark.sparkContext.broadcast(mine)

        def search(batches, asked=asked):
            from pyspark import TaskContext

            part, tops = TaskContext.get().partitionId(), [Lists(len(x[1]), k, np.float64) for x in asked.value]
            for batch in batches:
                for t in batch.to_pylist():
                    ids = np.frombuffer(t["ids"], np.int64)
                    m = np.frombuffer(t["vectors"], np.float64).reshape(len(ids), t["dim"])
                    starts, posted, place = (np.frombuffer(t[c], kind).astype(np.intp) for c, kind in (("starts", np.int32), ("rows", np.int32), ("places", np.uint16)))
                    deep = min(len(ids), max(LEAST, k + 1, int(np.ceil(depth * len(ids))))) if len(starts) > 1 else len(ids)
                    squared, kept = (m * m).sum(axis=1), max(1, len(posted) // len(ids))
                    for top, (_, own, q, near) in zip(tops, asked.value):
                        if q.shape[1] != m.shape[1]:
                            continue
                        got = []
                        for i in range(len(own)):
                            pick = _best(footrule(near[i], starts, posted, place, len(ids), kept), ids, deep) if deep < len(ids) else np.arange(len(ids))
                            pick = pick[ids[pick] != own[i]]
                            if len(pick) > k:  # the products say who may be among the k nearest, give or take their rounding
                                far = squared[pick] - 2 * (m[pick] @ q[i])
                                slack = 1e-9 * (squared[pick].max() + q[i] @ q[i])
                                pick = pick[far <= np.partition(far, k - 1)[k - 1] + slack]
                            gap = m[pick] - q[i]
                            got.append((np.full(len(pick), i), -np.sqrt((gap * gap).sum(axis=1)), ids[pick]))
                        top.add(*(np.concatenate(x) for x in zip(*got)))
            for top, (number, own, _, _) in zip(tops, asked.value):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (number[top.rows], own[top.rows], top.ids, 0.0 - top.score)] + [pa.array(np.full(len(top.rows), part, np.int32))], names=["query", "query_id", "vec_id", "score", "part"])

        partial = index.mapInArrow(tidy(search), "query long, query_id long, vec_id long, score double, part int")
        found.append(merge(partial, parts, k, [F.asc("score"), F.asc("vec_id")]))
    return all_blocks(found, empty)


def _best(rule: np.ndarray, ids: np.ndarray, deep: int) -> np.ndarray:
    """Rows of the ``deep`` smallest footrule distances, ties by the smaller id."""
    last = np.partition(rule, deep - 1)[deep - 1]
    sure = np.flatnonzero(rule < last)
    ties = np.flatnonzero(rule == last)
    return np.concatenate([sure, ties[np.argsort(ids[ties], kind="stable")][: deep - len(sure)]])

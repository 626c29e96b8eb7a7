"""Inner products of two groups of vectors, tile by tile: the best rows of each query, and sums over all pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A tile of scores has so many queries and rows: 16 MB of doubles.
TILE_QUERIES, TILE_ROWS = 512, 4096
#: What scores that are no numbers count as in comparisons: a query's own row, no score, minus infinity, infinity, not a number.
OWN, NONE, LOW, HIGH, NAN = -np.inf, -np.finfo(float).max, np.nextafter(-np.finfo(float).max, 0), np.finfo(float).max, np.inf


def matrix(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles, filled up with zeros, and their sizes; -1 for a null vector and one with a null component."""
    v = vectors.combine_chunks()
    size = np.asarray(pc.fill_null(pc.list_value_length(v), -1)).astype(np.int64)
    width = max(0, int(size.max(initial=0)))
    flat = v.flatten()  # components of null vectors are left out
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = np.asarray(pc.fill_null(flat, 0)).astype(np.float64)
    if flat.null_count:
        size[np.repeat(np.arange(len(size)), np.maximum(size, 0))[np.asarray(flat.is_null())]] = -1
    return out, size


def own_rows(asked: pa.ChunkedArray, ids: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """For each query, from and to which of the rows, which are in the order of their ids, are its own."""
    codes = pa.chunked_array([*ids.chunks, *asked.cast(ids.type).chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
    mine, of = codes[: len(ids)], codes[len(ids) :]  # codes by first appearance ascend as the ids do
    return np.searchsorted(mine, of, "left"), np.searchsorted(mine, of, "right")


def tiles(q: pa.Table, r: pa.Table):
    """(first query, first row, scores, own, plain) of every tile: ``own`` marks the queries' own rows by two lists; plain scores are finite numbers all."""
    (a, a_size), (b, b_size) = matrix(q.column("v")), matrix(r.column("v"))
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    begin, end = own_rows(q.column("id"), r.column("id"))
    alike = bool((a_size == width).all() and (b_size == width).all())
    plain = alike and bool(np.isfinite(a).all() and np.isfinite(b).all())
    for i in range(0, len(a), TILE_QUERIES):
        for j in range(0, len(b), TILE_ROWS):
            some, others = a[i : i + TILE_QUERIES], b[j : j + TILE_ROWS]
            with np.errstate(all="ignore"):
                score = some @ others.T
            if not plain:
                score = special(score, a_size[i : i + TILE_QUERIES], b_size[j : j + TILE_ROWS])
            low, high = (np.clip(x[i : i + TILE_QUERIES] - j, 0, len(others)) for x in (begin, end))
            n = high - low
            row = np.repeat(np.arange(len(some)), n)
            yield i, j, score, (row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]), plain


def special(score: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    score = np.select([np.isnan(score), score == np.inf, score == -np.inf], [NAN, HIGH, LOW], score)
    score[(a_size[:, None] != b_size) | (a_size[:, None] < 0)] = NONE
    return score


def rounded(score: np.ndarray, digits: int | None) -> np.ndarray:
    if digits is None:
        return score
    unit = 10.0**digits
    with np.errstate(over="ignore"):
        scaled = score * unit
        return np.where(np.isfinite(scaled), np.trunc(scaled + np.copysign(0.5, scaled)) / unit, score)


def best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's ``k`` highest scores; of equal ones, the first columns."""
    if score.shape[1] <= k:
        return np.nonzero(score > OWN)
    least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k, None]
    take, tied = score > least, score == least
    room = k - take.sum(axis=1)
    more = tied.sum(axis=1) > room
    tied[more] &= np.cumsum(tied[more], axis=1, dtype=np.int32) <= room[more, None]
    return np.nonzero((take | tied) & (score > OWN))


def nearest(q: pa.Table, r: pa.Table, k: int, digits: int | None) -> pa.Table:
    """The ``k`` best rows of each query: query_id, id, score, and what they are best by, the rounded score.

    The rows go by in the order of their ids: a later one must exceed a query's k-th so far, by half a unit of the last digit.
    """
    r = r.sort_by("id")
    found = []
    rows = at = raw = key = None
    for i, j, score, own, plain in tiles(q, r):
        score[own] = OWN
        n = len(score)
        if j == 0:
            rows, at, raw, key, bound = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.full(n, OWN)
        new = None
        if plain and (bound > OWN).all():
            over = score >= bound[:, None]
            if np.count_nonzero(over) <= n * k * 4:
                row, column = np.nonzero(over)
                new = rounded(score[row, column], digits)
        if new is None:
            whole = rounded(score, digits)
            row, column = best(whole, k)
            new = whole[row, column]
        rows, at, raw, key = np.concatenate([rows, row]), np.concatenate([at, j + column]), np.concatenate([raw, score[row, column]]), np.concatenate([key, new])
        by = np.lexsort((at, -key, rows))
        rows, at, raw, key = rows[by], at[by], raw[by], key[by]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        rows, at, raw, key, place = (x[place < k] for x in (rows, at, raw, key, place))
        last = place == k - 1
        bound = np.full(n, OWN)
        bound[rows[last]] = key[last] - 1e-15 * np.abs(key[last]) + (0 if digits is None else 0.499 * 10.0**-digits)
        if j + score.shape[1] >= len(r):
            found.append((i + rows, at, raw, key))
    rows, at, raw, key = (np.concatenate([f[x] for f in found] or [np.zeros(0)]) for x in range(4))
    value = [pa.array(np.select([x == NAN, x == HIGH, x == LOW], [np.nan, np.inf, -np.inf], x), mask=x == NONE) for x in (raw, key)]
    rows, at = pa.array(rows.astype(np.int64)), pa.array(at.astype(np.int64))
    return pa.table({"query_id": q.column("id").take(rows), "id": r.column("id").take(at), "score": value[0], "rounded": value[1]})


def summary(q: pa.Table, r: pa.Table) -> pa.Table:
    """One row: the pairs of a query and another row, those with a score, and the sum and the maximum of the scores."""
    pairs = scored = 0
    total, greatest = [], OWN
    for _, _, score, own, plain in tiles(q, r.sort_by("id")):
        pairs += score.size - len(own[0])
        score[own] = OWN
        if plain:
            scored += score.size - len(own[0])
            greatest = max(greatest, score.max(initial=OWN))
            score[own] = 0
            total.append(score.sum())
            continue
        there = score[score > NONE]
        scored += len(there)
        greatest = max(greatest, there.max(initial=OWN))
        total.append(np.select([there == NAN, there == HIGH, there == LOW], [np.nan, np.inf, -np.inf], there).sum())
    top = {NAN: np.nan, HIGH: np.inf, LOW: -np.inf}.get(float(greatest), greatest)
    some = scored > 0
    return pa.table({"pairs": [pairs], "scored": [scored], "total": pa.array([float(sum(total)) if some else None], pa.float64()), "greatest": pa.array([float(top) if some else None], pa.float64())})

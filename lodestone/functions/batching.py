"""Batches for models that pad: packing by length, pooling, and the choice of a device."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def packed(lengths: list[int], items: int, tokens: int) -> Iterator[np.ndarray]:
    """Positions in batches of like lengths: at most ``items`` each, at most ``tokens`` after padding, but one item at least.

    In ascending order the last of a batch is its widest, so what a batch costs grows with its end: the end is looked up.
    """
    order = np.argsort(lengths, kind="stable")
    ascending = np.asarray(lengths, np.int64)[order]
    begin = 0
    while begin < len(order):
        ahead = ascending[begin : begin + max(1, items)]
        fit = np.searchsorted(ahead * np.arange(1, len(ahead) + 1), tokens, side="right")
        end = begin + max(1, int(fit))
        yield order[begin:end]
        begin = end


def padded(ids: list[list[int]], pad: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Token ids padded to the longest, and the mask of real ones."""
    width = max(map(len, ids), default=0)
    out, mask = np.full((len(ids), width), pad, np.int64), np.zeros((len(ids), width), np.int64)
    for row, x in enumerate(ids):
        out[row, : len(x)], mask[row, : len(x)] = x, 1
    return out, mask


def unit(v: np.ndarray) -> np.ndarray:
    """Rows to unit length: norms in doubles, results in floats; zero and non-finite rows are errors."""
    n = np.sqrt((v.astype(np.float64) ** 2).sum(axis=-1, keepdims=True))
    if not np.isfinite(n).all() or (n == 0).any():
        raise ValueError("vector without a direction")
    return (v / n).astype(np.float32)


def pooled(states: np.ndarray, mask: np.ndarray, how: str = "cls") -> np.ndarray:
    """Unit vectors from token states: the first token's, or the mean over real tokens, each divided before it is added."""
    if states.ndim != 3 or states.shape[:2] != mask.shape:
        raise ValueError("unexpected shape")
    if how == "cls":
        return unit(states[:, 0])
    if how != "mean":
        raise ValueError(f"unknown pooling {how!r}")
    count = mask.sum(axis=1).astype(np.float32)
    total = np.zeros((states.shape[0], states.shape[2]), np.float32)
    for t in range(states.shape[1]):
        total += np.where(mask[:, t, None] > 0, states[:, t].astype(np.float32) / count[:, None], np.float32(0))
    return unit(total)


def embed_all(ids: list[list[int]], infer, items: int, tokens: int, dimensions: int) -> np.ndarray:
    """Vectors in the order of the inputs; what does not fit the memory is cut in two, and later batches are no larger than the halves."""
    out = np.zeros((len(ids), dimensions), np.float32)
    waiting = np.arange(len(ids))
    while len(waiting):
        some = waiting[next(packed([len(ids[i]) for i in waiting], items, tokens))]
        try:
            out[some] = infer(*padded([ids[i] for i in some]))
        except MemoryError:
            if len(some) == 1:
                raise
            items = len(some) // 2
            tokens = max(1, items * max(len(ids[i]) for i in some))
            continue
        waiting = np.setdiff1d(waiting, some, assume_unique=True)
    return out


def usable(free: int, total: int, fraction: float = 1.0) -> int:
    """Bytes of a device to plan with: headroom is the greater of 512 MiB and 15 %."""
    return max(0, int(min(free, total * fraction)) - max(512 << 20, total * 15 // 100))


def choose(devices: list[dict], fraction: float = 1.0) -> dict | None:
    """The device (index, uuid, free, total) with most usable memory, the first of equal ones; None if none has any."""
    best = max(devices, key=lambda d: usable(d["free"], d["total"], fraction), default=None)
    return best if best and usable(best["free"], best["total"], fraction) > 0 else None

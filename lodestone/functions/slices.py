"""Arrow batches in slices of bounded weight, so that what Python makes of a batch stays small however long its rows are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Weight of one slice: bytes of texts, or tokens, whichever a caller counts. A heavier row is a slice of its own.
TEXT_BYTES, TOKENS = 1 << 20, 1 << 18


def bounded(batches, weights, most: int) -> Iterator[pa.RecordBatch]:
    """``batches`` in slices whose ``weights(batch)`` add up to ``most`` at the most, rows in their order; empty batches are left out."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(weights(batch), 0)).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end
        del batch


def of_text(column: str):
    return lambda batch: pc.binary_length(batch.column(column))


def of_list(column: str):
    return lambda batch: pc.list_value_length(batch.column(column))

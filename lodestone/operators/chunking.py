"""Overlapping token windows as a closed form over arrays, without a loop over tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import slices


def window_count(n: Column, capacity: int, overlap: int) -> Column:
    """Windows over n tokens: none for none, one if they fit, else as many as reach the last token."""
    if overlap >= capacity:
        raise ValueError("overlap must be smaller than the window")
    more = F.ceil((n - capacity) / F.lit(capacity - overlap)) + 1
    return F.when(n <= 0, 0).when(n <= capacity, 1).otherwise(more).cast("long")


def windows(rows: DataFrame, count_col: str, capacity: int, overlap: int) -> DataFrame:
    """One row per window: ordinal, token_start, token_end (half-open)."""
    n = F.col(count_col).cast("long")
    step = capacity - overlap
    made = rows.withColumn("_w", window_count(n, capacity, overlap)).filter("_w > 0").withColumn("ordinal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_w") - 1)))
    return made.withColumn("token_start", F.col("ordinal") * step).withColumn("token_end", F.least(F.col("token_start") + capacity, n)).drop("_w")


def with_offsets(rows: DataFrame, offsets: Callable[[str], list[tuple[int, int]]], text_col: str = "text") -> DataFrame:
    """``rows`` with the byte ranges of their texts' tokens; null and blank texts have none. Tokenizers run in Arrow batches, by slices of bounded bytes."""
    schema = T.StructType([*rows.schema.fields, T.StructField("offsets", T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())])))])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in slices.bounded(batches, slices.of_text(text_col), slices.TEXT_BYTES):
            ends, parts = [0], []
            for t in batch.column(text_col):
                t = t.as_py()
                found = np.asarray(offsets(t) if t and t.strip() else [], np.int32).reshape(-1, 2)
                parts.append(found)
                ends.append(ends[-1] + len(found))
            flat = np.concatenate(parts)
            pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["s", "e"])
            made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "offsets"])

    return rows.mapInArrow(run, schema)


def chunks(rows: DataFrame, capacity: int, overlap: int, text_col: str = "text", offsets_col: str = "offsets", ids_col: str | None = None, frame: tuple[int, int] = (0, 2)) -> DataFrame:
    """Windows with their byte ranges and texts, from byte offsets (array of struct s, e) of the tokens.

    The first window starts at byte 0 and the last ends with the text; one between ends at the later of its
    last token's end and the start of the token after it. Token ids, if given, come framed by the two special ids.
    """
    total = F.size(offsets_col)
    w = windows(rows.withColumn("_n", total), "_n", capacity, overlap)
    last = F.col("token_end") == F.col("_n")
    at = lambda i: F.element_at(F.col(offsets_col), i.cast("int"))
    begin = F.when(F.col("ordinal") == 0, F.lit(0)).otherwise(at(F.col("token_start") + 1)["s"])
    following = at(F.least(F.col("token_end") + 1, F.col("_n")))["s"]
    end = F.when(last, F.octet_length(text_col)).otherwise(F.greatest(at(F.col("token_end"))["e"], following))
    out = w.withColumn("byte_start", begin.cast("long")).withColumn("byte_end", end.cast("long"))
    raw = F.col(text_col).cast("binary")
    out = out.withColumn("chunk_text", F.substring(raw, (F.col("byte_start") + 1).cast("int"), (F.col("byte_end") - F.col("byte_start")).cast("int")).cast("string"))
    if ids_col:
        ids = F.slice(F.col(ids_col), (F.col("token_start") + 1).cast("int"), (F.col("token_end") - F.col("token_start")).cast("int"))
        out = out.withColumn("model_ids", F.concat(F.array(F.lit(frame[0])), ids, F.array(F.lit(frame[1]))))
    return out.drop("_n")

"""Token-ID output in patched frame-of-reference blocks.

A segment holds the ids of consecutive documents. Ids are cut into blocks of 128. Of each block the minimum is
taken off; the rest is packed at the width that holds PERCENTILE of the block's values; values that need more
bits leave their low bits in place and their position and high bits in the segment's exception lists. A block
index gives where each block starts, so that any block can be read alone. Before the blocks of ids, a segment lists its
documents and, in blocks of the same kind, how many ids each has.

A segment is one byte string; a store of segments is a Parquet folder, which Spark writes with an atomic commit
to any file system it knows and can read from any executor.
"""

from __future__ import annotations

import bisect
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, small_batches, tasks, tidy
from .words import Splitter, default_vocabulary, library_words

MAGIC = b"PFR1"
BLOCK = 128
PERCENTILE = 90
END_ID = 1
#: Ids of a segment, but for a longer last document.
SEGMENT_IDS = 1 << 20


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.uint8)


def pack(ids: np.ndarray) -> bytes:
    """Blocks of unsigned 32-bit ids: header, block index (minimum, width, start, first exception), data, exceptions."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.full(blocks * BLOCK, ids[-1] if n else 0, np.uint32)
    full[:n] = ids
    full = full.reshape(blocks, BLOCK)
    least = full.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = full - least[:, None]
    nth = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    width = _bits(np.partition(rest, nth, axis=1)[:, nth]) if blocks else np.zeros(0, np.uint8)
    high = (rest.astype(np.uint64) >> width.astype(np.uint64)[:, None]).astype(np.uint32)
    where_block, where_at = np.nonzero(high)
    lengths = width.astype(np.int64) * BLOCK // 8
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.uint64)
    first = np.searchsorted(where_block, np.arange(blocks + 1)).astype(np.uint32)
    data = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width[width > 0]):
        mine = np.flatnonzero(width == w)
        shifts = np.arange(int(w), dtype=np.uint32)
        for part in np.array_split(mine, -(-len(mine) // 4096)):
            bit = ((rest[part][:, :, None] >> shifts) & 1).astype(np.uint8)
            packed = np.packbits(bit.reshape(len(part), -1), axis=1, bitorder="little")
            data[starts[part].astype(np.int64)[:, None] + np.arange(packed.shape[1])] = packed
    head = struct.pack("<4sIQII", MAGIC, BLOCK, n, blocks, len(where_at))
    return b"".join([head, least.tobytes(), width.tobytes(), starts.tobytes(), first.tobytes(), data.tobytes(), where_at.astype(np.uint8).tobytes(), high[where_block, where_at].tobytes()])


def _parts(blob: bytes):
    magic, block, n, blocks, patches = struct.unpack_from("<4sIQII", blob)
    if magic != MAGIC:
        raise ValueError("not a segment")
    at = struct.calcsize("<4sIQII")
    out = []
    for kind, count in ((np.uint32, blocks), (np.uint8, blocks), (np.uint64, blocks + 1), (np.uint32, blocks + 1)):
        out.append(np.frombuffer(blob, kind, count, at))
        at += out[-1].nbytes
    size = int(out[2][-1])
    out.append(np.frombuffer(blob, np.uint8, size, at))
    out.append(np.frombuffer(blob, np.uint8, patches, at + size))
    out.append(np.frombuffer(blob, np.uint32, patches, at + size + patches))
    return block, n, *out


def unpack(blob: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids [start, stop) of a segment; only the blocks that hold them are read."""
    block, n, least, width, starts, first, data, patch_at, patch = _parts(blob)
    stop = n if stop is None else min(stop, n)
    lo, hi = start // block, -(-stop // block)
    if stop <= start:
        return np.zeros(0, np.uint32)
    out = np.zeros((hi - lo, block), np.uint32)
    for w in np.unique(width[lo:hi]):
        mine = np.flatnonzero(width[lo:hi] == w)
        if w:
            for part in np.array_split(mine, -(-len(mine) // 4096)):
                raw = data[starts[lo + part].astype(np.int64)[:, None] + np.arange(int(w) * block // 8)]
                bit = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(part), block, int(w))
                low = np.zeros((len(part), block), np.uint32)
                for j in range(int(w)):
                    low |= bit[:, :, j].astype(np.uint32) << np.uint32(j)
                out[part] = low
    where = np.repeat(np.arange(hi - lo), np.diff(first[lo : hi + 1]).astype(np.int64))
    mine = slice(int(first[lo]), int(first[hi]))
    wide = width[lo:hi][where].astype(np.uint64)
    out[where, patch_at[mine]] |= (patch[mine].astype(np.uint64) << wide).astype(np.uint32)
    return (out + least[lo:hi, None]).reshape(-1)[start - lo * block : stop - lo * block]


DOCUMENTS = "<4sQQ"


def pack_segment(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A whole segment: documents and the blocks of their ids."""
    sizes = pack(np.asarray(lengths, np.uint32))
    head = struct.pack(DOCUMENTS, b"PFS1", len(doc_ids), len(sizes))
    named = np.array([i is not None for i in doc_ids], bool)
    return b"".join([head, np.array([i or 0 for i in doc_ids], "<i8").tobytes(), np.packbits(named).tobytes(), sizes, pack(ids)])


def unpack_segment(blob: bytes) -> tuple[list, np.ndarray, bytes]:
    """Document ids, how many ids each has, and the blocks."""
    magic, n, size = struct.unpack_from(DOCUMENTS, blob)
    if magic != b"PFS1":
        raise ValueError("not a segment")
    at = struct.calcsize(DOCUMENTS)
    doc_ids = np.frombuffer(blob, "<i8", n, at).tolist()
    named = np.unpackbits(np.frombuffer(blob, np.uint8, -(-n // 8), at + 8 * n), count=n).tolist()
    at += 8 * n + -(-n // 8)
    return [i if ok else None for i, ok in zip(doc_ids, named)], unpack(blob[at : at + size]).astype(np.int64), blob[at + size :]


SEGMENTS = "part int, segment int, part_start long, n long, blob binary"
ARROW = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("part_start", pa.int64()), ("n", pa.int64()), ("blob", pa.binary())])
#: Rows looked at for each part to choose the parts' bounds.
LOOKED_AT = 20


def _order(doc_id, crc):
    """Where a row stands: null ids first, then by id, then by the text's checksum."""
    return doc_id is not None, doc_id or 0, crc


def part_of(place: tuple, bounds: list[tuple], turn: int) -> int:
    """The part of a row; rows with one place that bounds several parts are dealt to these in turn."""
    first, last = bisect.bisect_left(bounds, place), bisect.bisect_right(bounds, place)
    return last - turn % (last - first) if last - first > 1 else last


def part_bounds(rows: DataFrame, parts: int) -> list[tuple]:
    """The first places of all parts but one, from a random sample of about LOOKED_AT rows a part. Results don't depend on them."""
    n = rows.count()
    seen = rows.select("doc_id", "crc").sample(min(1.0, LOOKED_AT * parts / n), seed=7).collect() if n else []
    places = sorted(_order(*r) for r in seen)
    return [places[len(places) * i // parts] for i in range(1, parts)] if places else []


def write_segments(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Encode every text and write segments in ascending ``id_col`` order under the shared folder; returns them as read.

    Each document's ids end with ``end_id``. Texts are encoded where they are; their ids, not they, are dealt into parts,
    ranges of ``id_col`` with one task each. A segment is about ``segment_ids`` ids of a part.

    Defined cases: a null text is empty (its end id alone); null ids come first; rows with the same id follow
    each other, ordered by their texts; an empty table gives no segments; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = vocabulary or default_vocabulary()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.crc32(text).alias("crc"), text.alias("text"))
    parts = tasks(spark)
    bounds = spark.sparkContext.broadcast(part_bounds(rows, parts))
    kind = "<u2" if max(end_id, Splitter(path).most) < 1 << 16 else "<u4"

    def encoded(batches):
        words, end = library_words(path), np.array([end_id], kind)
        for batch in batches:
            places = [part_of(_order(*x), bounds.value, turn) for turn, x in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("crc").to_pylist()))]
            ids = [np.append(x.astype(kind), end).tobytes() for x in words.encode(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), batch.column("doc_id"), batch.column("crc"), pa.array(ids, pa.binary())], names=["part", "doc_id", "crc", "ids"])

    dealt = rows.mapInArrow(tidy(encoded), "part int, doc_id long, crc long, ids binary").repartitionById(parts, "part").sortWithinPartitions("part", "doc_id", "crc")

    def write(batches):
        part, doc_ids, run, held, number, begun = 0, [], [], 0, 0, 0

        def segment():
            return pa.RecordBatch.from_pylist([{"part": part, "segment": number, "part_start": begun, "n": held, "blob": pack_segment(doc_ids, [len(x) for x in run], np.concatenate(run).astype(np.uint32))}], schema=ARROW)

        for batch in batches:
            for place, doc_id, ids in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids")):
                if run and (place != part or held >= segment_ids):
                    yield segment()
                    number, begun = (number + 1, begun + held) if place == part else (0, 0)
                    doc_ids, run, held = [], [], 0
                part = place
                run.append(np.frombuffer(ids.as_buffer(), kind))
                doc_ids.append(doc_id)
                held += len(run[-1])
        if run:
            yield segment()

    return keep(dealt.mapInArrow(tidy(write), SEGMENTS), "token-segments")


def read_documents(segments: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before; part totals (one short row per task of the writer) are
    summed once and joined back.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = segments.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    schema = "part int, doc_id long, at long, n_tokens long, ids_crc32 long"

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                doc_ids, n, blocks = unpack_segment(row["blob"])
                ends = np.cumsum(n)
                raw = memoryview(unpack(blocks).astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(n), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(row["part_start"] + ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                    names=["part", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    docs = segments.select("part", "part_start", "blob").mapInArrow(tidy(read), schema)
    return docs.join(bases, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def start_of(spark: SparkSession, at: str) -> DataFrame:
    """Open a store of segments that an earlier run wrote."""
    return spark.read.schema(SEGMENTS).parquet(at)

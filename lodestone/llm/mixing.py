"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The words of a source are laid end to end in a seeded order and cut into blocks of equal length. Every source
gets an exact quota of blocks (whole passes over the source, then part of one more). The shards that the
mixture is dealt to are the leaves of a binary tree: at each node the quota vector is divided between the left
and the right half of the shards by one multivariate-hypergeometric draw, so that each shard gets an exact
number of blocks and, over all shards, each source exactly its quota. A leaf then owns a range of positions
in each source's permuted block order; the permutation is computed, not stored, so ranges are disjoint by
construction. A node's draw depends on the seed and the node alone: any task derives the same tree.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, small_batches, tidy

WORD = r"[^\x20\x09-\x0D]+"
#: Sources whose totals the driver plans with; one short row each.
MOST_SOURCES = 1_000_000
#: The hypergeometric sampler counts up to 10**9 items; larger corpora get longer blocks instead.
MOST_BLOCKS = 1 << 29

SLICES = T.ArrayType(
    T.StructType(
        [
            T.StructField("shard", T.IntegerType()),
            T.StructField("order", T.LongType()),
            T.StructField("epoch", T.IntegerType()),
            T.StructField("first_word", T.LongType()),
            T.StructField("n_words", T.LongType()),
        ]
    )
)


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Share ``total`` by weight; no share goes above ``most`` times its size, the excess is shared again."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        base = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / base > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / base
            break
        for i in over:
            out[i] = float(most * sizes[i])
            open_.discard(i)
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (xor-shift and multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(mul)
    return x ^ (x >> np.uint64(31))


def permute(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """Position of each of ``i`` in a keyed permutation of range(n): a Feistel network, walked until below n."""
    if n <= 1:
        return i.astype(np.int64)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out = i.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for r in range(4):
            salt = np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % (1 << 64))
            left, right = right, left ^ (mix64(right ^ salt) & low)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


class Tree:
    """The splitting tree over shards 0 .. n-1; leaf sizes differ by one block at most."""

    def __init__(self, quotas: list[int], shards: int, seed: int):
        self.quotas, self.shards, self.seed = np.asarray(quotas, np.int64), shards, seed
        self.total = int(self.quotas.sum())
        self.lefts: dict[tuple[int, int], np.ndarray] = {}

    def blocks_before(self, shard: int) -> int:
        return self.total * shard // self.shards

    def left(self, lo: int, hi: int, colors: np.ndarray) -> np.ndarray:
        """How many blocks of each source go to the left half of the shards [lo, hi)."""
        if (lo, hi) not in self.lefts:
            mid = (lo + hi) // 2
            draw = self.blocks_before(mid) - self.blocks_before(lo)
            rng = np.random.Generator(np.random.PCG64([self.seed, lo, hi]))
            self.lefts[lo, hi] = rng.multivariate_hypergeometric(colors, draw) if draw else np.zeros_like(colors)
        return self.lefts[lo, hi]

    def leaf(self, shard: int) -> np.ndarray:
        """The quotas of one shard."""
        lo, hi, colors = 0, self.shards, self.quotas
        while hi - lo > 1:
            mid, left = (lo + hi) // 2, self.left(lo, hi, colors)
            lo, hi, colors = (lo, mid, left) if shard < mid else (mid, hi, colors - left)
        return colors

    def shard_of(self, source: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The shards of the blocks at ``place`` in their sources' permuted orders."""
        out = np.zeros(len(source), np.int32)
        stack = [(0, self.shards, self.quotas, np.arange(len(source)), place.astype(np.int64))]
        while stack:
            lo, hi, colors, rows, at = stack.pop()
            if not len(rows):
                continue
            if hi - lo == 1:
                out[rows] = lo
                continue
            mid, left = (lo + hi) // 2, self.left(lo, hi, colors)
            goes = at < left[source[rows]]
            stack.append((lo, mid, left, rows[goes], at[goes]))
            stack.append((mid, hi, colors - left, rows[~goes], (at - left[source[rows]])[~goes]))
        return out


class Plan:
    """Quotas of all sources; ``cut`` gives the slices that the mixture takes of documents."""

    def __init__(self, sizes, quotas, block, shards, seed):
        self.block, self.seed = block, seed
        self.size, self.quota = np.asarray(sizes, np.int64), np.asarray(quotas, np.int64)
        self.blocks = -(-self.size // block)
        safe = np.maximum(self.size, 1)
        self.passes = self.quota // safe
        self.rest = self.quota - self.passes * self.size
        self.short = self.size - (self.blocks - 1) * block  # words of a source's last block
        self.last_at = np.array([int(permute(np.array([n - 1]), int(n), self.key(s, int(p)))[0]) if n else 0 for s, (n, p) in enumerate(zip(self.blocks, self.passes))], np.int64)
        self.part = np.array([self._part(s) for s in range(len(self.size))], np.int64)
        self.shards = shards or max(1, min(1 << 16, math.ceil(int((self.passes * self.blocks + self.part).sum()) / 1024)))
        self.tree = Tree(list(self.passes * self.blocks + self.part), self.shards, seed)

    def key(self, source: int, epoch: int) -> int:
        return (self.seed * 1_000_003 + source) * 1_009 + epoch

    def words_before(self, s, place):
        """Words of a source's last pass in blocks at places before ``place``."""
        return place * self.block - (self.last_at[s] < place) * (self.block - self.short[s])

    def _part(self, s: int) -> int:
        """Blocks that the last pass begins: enough for its words, the last of them maybe in part."""
        n = int(-(-self.rest[s] // self.block))
        while n < self.blocks[s] and self.words_before(s, n) < self.rest[s]:
            n += 1
        return n

    def cut(self, source: np.ndarray, start: np.ndarray, size: np.ndarray):
        """Slices of documents that lie at ``start`` in their source: row, shard, order, epoch, first, words."""
        first, last = start // self.block, (start + size - 1) // self.block
        count = np.where(size > 0, last - first + 1, 0)
        row = np.repeat(np.arange(len(size)), count)
        number = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        begin = np.maximum(start[row], number * self.block)
        end = np.minimum(start[row] + size[row], (number + 1) * self.block)
        src = source[row]
        found = []
        for s in np.unique(src):
            mine = np.flatnonzero(src == s)
            n, whole = int(self.blocks[s]), int(self.passes[s])
            for epoch in range(whole + (self.part[s] > 0)):
                place = permute(number[mine], n, self.key(int(s), epoch))
                a, b, at = begin[mine], end[mine], mine
                if epoch == whole:
                    room = np.minimum(self.rest[s] - self.words_before(s, place), self.block)
                    b = np.minimum(b, number[mine] * self.block + room)
                    ok = (place < self.part[s]) & (b > a)
                    place, a, b, at = place[ok], a[ok], b[ok], mine[ok]
                where = epoch * n + place
                shard = self.tree.shard_of(np.full(len(at), s), where)
                order = mix64(where.astype(np.uint64) ^ np.uint64((self.key(int(s), epoch) * 0x9E3779B97F4A7C15) % (1 << 64))).view(np.int64)
                found.append(np.stack([row[at], shard, order, np.full(len(at), epoch), a - start[row[at]], b - a]))
        return np.concatenate(found, axis=1) if found else np.zeros((6, 0), np.int64)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(1, 2, 3), most: int = 3, share: float = 1.0, block_words: int = 1024, shards: int | None = None, seed: int = 7, carry=(), _prefixed: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, slices and the ``carry`` columns.

    ``slices`` lists what the mixture takes of the document: shard, order (the sort key inside the shard, the
    local shuffle), epoch (which pass), first_word and n_words. Sources ordered by code point, null last, get
    ``weights`` in turn; together they share ``share`` of all words, none above ``most`` times its size.

    Defined cases: a null text counts as empty (size 0, nothing taken); a null source is a source of its own;
    null and repeated doc_ids are rows like any other; equal rows are laid side by side; an empty table gives
    an empty result; other columns, whatever their names, are ignored unless named in ``carry``.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("_o"), *[F.col(f"`{c}`").alias(f"_carry_{c}") for c in carry],
    ).withColumn("_s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    buckets = 1024  # a source's order is cut into so many parts, so that no task orders a whole source
    rows = rows.withColumn("_b", F.pmod("_o", F.lit(buckets)))
    sums = keep(rows.groupBy("_s", "_b").agg(F.sum("size").alias("_n")), "mix-sums")
    totals = sums.groupBy("_s").agg(F.sum("_n").alias("n"))
    if totals.limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found = {r["_s"]: int(r["n"]) for r in totals.collect()}
    names = sorted((s for s in found if s != "n"), key=lambda s: s) + [s for s in found if s == "n"]
    sizes = [found[s] for s in names]
    total = share * sum(sizes)
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], total, most)
    block = max(block_words, math.ceil(most * sum(sizes) / MOST_BLOCKS))
    plan = Plan(sizes, [min(round(g), most * n) for g, n in zip(goal, sizes)], block, shards, seed)
    index = {s: i for i, s in enumerate(names)}

    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_s", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_s", "_b").orderBy("_o", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(bases, ["_s", "_b"]).withColumn("_at", F.col("_base") + F.sum("size").over(inside) - F.col("size"))

    ints = [("source_size", T.LongType()), ("target", T.DoubleType()), ("taken", T.LongType())]
    kept = ["doc_id", "source", "size", *[f"_carry_{c}" for c in carry]]
    schema = T.StructType([placed.schema[c] for c in kept] + [T.StructField(n, t) for n, t in ints] + [T.StructField("slices", SLICES)])

    def cut(batches):
        for batch in batches:
            src = np.array([index[s] for s in batch.column("_s").to_pylist()], np.int64)
            at, size = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_at", "size"))
            row, shard, order, epoch, first, words = plan.cut(src, at, size)
            by = np.lexsort((first, epoch, row))
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(size)))]).astype(np.int32)
            parts = pa.StructArray.from_arrays(
                [pa.array(shard[by], pa.int32()), pa.array(order[by], pa.int64()), pa.array(epoch[by], pa.int32()), pa.array(first[by], pa.int64()), pa.array(words[by], pa.int64())],
                names=["shard", "order", "epoch", "first_word", "n_words"],
            )
            taken = np.bincount(row, weights=words, minlength=len(size)).astype(np.int64)
            more = [pa.array(plan.size[src], pa.int64()), pa.array(np.asarray(goal)[src] if len(src) else [], pa.float64()), pa.array(taken, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + more, names=[*kept, "source_size", "target", "taken", "slices"])

    out = placed.select("_s", "_at", *kept).mapInArrow(tidy(cut), schema)
    return out if _prefixed else out.withColumnsRenamed({f"_carry_{c}": c for c in carry})


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """``docs`` as the mixture takes them: the same columns, a row per document and pass, texts cut to the words that the pass takes.

    Defined cases: as of ``mix``; documents of which nothing is taken, empty and null texts among them, are left out; other
    columns, whatever their names, are carried along as they are.
    """
    carried = [c for c in docs.columns if c != id_col and (c != source_col or docs.schema[c].dataType != T.StringType())]
    rows = mixed_texts(mix(docs, id_col, text_col, source_col, carry=carried, _prefixed=True, **how), f"_carry_{text_col}")
    names = {id_col: "doc_id"} | ({} if source_col in carried else {source_col: "source"})
    return rows.select(*[F.col(f"`{names.get(c, f'_carry_{c}')}`").alias(c) for c in docs.columns])


def dealt(mixed: DataFrame) -> DataFrame:
    """The mixture itself: one row per slice, each shard in its shuffled order."""
    return mixed.select("doc_id", "source", F.explode("slices").alias("x")).select("doc_id", "source", "x.*").repartition("shard").sortWithinPartitions("shard", "order", "first_word")


def mixed_texts(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mixture as documents: a row per document and pass, its text cut to the words that the pass takes.

    ``mixed`` carries ``text_col``. A document taken whole keeps its text as it is; of one taken in part, each run of
    words that follow each other is one stretch of the text, and stretches are joined by a line break.
    """
    kept = [c for c in mixed.columns if c not in ("slices", "size", "source_size", "target", "taken")]
    schema = mixed.select(*kept).schema
    word = re.compile(WORD)

    def run(batches):
        for batch in batches:
            rows, texts = [], []
            everything = zip(batch.column(text_col).to_pylist(), batch.column("size").to_pylist(), batch.column("slices").to_pylist())
            for i, (text, size, slices) in enumerate(everything):
                epochs: dict[int, list[tuple[int, int]]] = {}
                for x in slices:
                    epochs.setdefault(x["epoch"], []).append((x["first_word"], x["first_word"] + x["n_words"]))
                places = None
                for runs in epochs.values():
                    if sum(b - a for a, b in runs) == size:
                        part = text
                    else:
                        places = places or [m.span() for m in word.finditer(text)]
                        whole: list[list[int]] = []
                        for a, b in sorted(runs):
                            if whole and whole[-1][1] == a:
                                whole[-1][1] = b
                            else:
                                whole.append([a, b])
                        part = "\n".join(text[places[a][0] : places[b - 1][1]] for a, b in whole)
                    rows.append(i)
                    texts.append(part)
            taken = batch.select(kept).take(pa.array(rows, pa.int64()))
            arrays = list(taken.columns)
            arrays[kept.index(text_col)] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=kept)

    return mixed.select(*kept, "size", "slices").mapInArrow(tidy(run), schema)

"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its five-word shingles: the count times a factor that grows with the shingle's inverse
document frequency. Frequencies are counted over all documents in a fixed number of hashed bins, less the noise of
the shingles that share a bin. Consistent samples, SAMPLES a text, are cut into bands; texts that share a band are
candidates. Candidates are verified by their weighted Jaccard similarity over all shingles.

Equal texts are one node throughout. A bucket is open while its nodes lie in several components. The nodes of an open
bucket meet in one task, which works out all their similarities as products of matrices over the shingles that
several of them share, and passes on no more links than join components. A bucket too large for a task is cut:

1. its hashed pieces meet, each with a few leaders of the whole bucket, which joins what is alike to a large component;
2. the nodes outside the largest component then meet all others, block by block;
3. where those are too many for that, the bucket is first split by prefixes: of two sets as similar as asked for, the first
   part of each, in one order of all shingles from rare to common, up to a fifth of its weight, shares a shingle. So no pair
   is lost, and texts that only share a common passage part. The parts are treated as buckets, by steps 1 and 2.

Every pair of nodes that shares a bucket thus ends in one component or has been compared, whatever the bucket's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, groups, keep, small_batches, text_key, tidy
from .shingles import ID_BITS, mix64, shingle_lists, shingle_sets
from .words import spread

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 13, 4
SAMPLES = BANDS * ROWS
#: Hashed bins of document frequencies, and the pieces they are summed in.
BIN_BITS, BIN_PIECES = 18, 8
#: A shingle's weight is its count times 1 + LIFT * idf, idf between 0 and 1. A larger lift lets the rare shingles of
#: an edit outweigh what a large group of copies shares, because copies raise the frequency of all that they share.
LIFT = 0.25
#: Nodes and shingles that meet in a task, the leaders that each piece of a larger bucket meets, and the blocks of nodes outside
#: the largest component above which a bucket is split by prefixes.
BLOCK, BLOCK_SHINGLES, LEADERS, MANY = 1024, 2 << 20, 4, 16
#: Bands that are looked at together; the later ones meet what the earlier ones have joined.
TURNS = (range(3), range(3, BANDS))
#: Bits of the fixed-size filter that spares texts without candidates a shuffle.
FILTER_BITS = 24


def bins(ids: np.ndarray) -> np.ndarray:
    return (ids >> np.uint64(ID_BITS - BIN_BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Documents per bin, over all documents; every task sends fixed-size counts, which are summed in two steps."""
    each = (1 << BIN_BITS) // BIN_PIECES

    def count(batches):
        from pyspark import TaskContext

        part, total, n = TaskContext.get().partitionId(), np.zeros(1 << BIN_BITS, np.int64), 0
        for batch in batches:
            for texts in groups([t or "" for t in batch.column(0).to_pylist()]):
                ids, _, _ = shingle_sets(texts, WORDS)
                total += np.bincount(bins(ids), minlength=1 << BIN_BITS)
                n += len(texts)
        if n:
            parts = [p.astype(np.int64).tobytes() for p in total.reshape(BIN_PIECES, each)] + [np.int64(n).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(range(BIN_PIECES + 1), pa.int32()), pa.array([part // 64] * (BIN_PIECES + 1), pa.int32()), pa.array(parts, pa.binary())], names=["piece", "step", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("n"))
        return pa.table({"piece": table.column("piece")[:1], "step": pa.array([0], pa.int32()), "n": pa.array([total.tobytes()], pa.binary())})

    schema = "piece int, step int, n binary"
    rows = docs.select(text_col).mapInArrow(tidy(count), schema).groupBy("piece", "step").applyInArrow(add, schema).groupBy("piece").applyInArrow(add, schema).collect()
    found = {r["piece"]: np.frombuffer(r["n"], np.int64) for r in rows}
    if not found:
        return np.zeros(1 << BIN_BITS, np.int64), 0
    return np.concatenate([found[p] for p in range(BIN_PIECES)]), int(found[BIN_PIECES][0])


def bin_weights(counts: np.ndarray, n: int) -> np.ndarray:
    """1 + LIFT * idf per bin; idf is ln(n / df) over ln(n + 2).

    Shingles that share a bin add noise to its count: of the mean of all bins, give or take its root. What a bin holds above
    the mean and four times the root is its frequency, so that rare shingles have the same weight in a corpus of any size.
    """
    noise = float(counts.mean())
    idf = np.log(max(n, 1) / np.clip(counts - noise - 4 * np.sqrt(noise), 1, max(n, 1))) / np.log(n + 2)
    return (1 + LIFT * np.clip(idf, 0, 1)).astype(np.float32)


def _tables():
    u = (np.arange(65536) + 0.5) / 65536
    exponential = -np.log(u)
    lo, hi = np.zeros(65536), np.full(65536, 60.0)
    for _ in range(60):  # quantiles of the gamma distribution of shape 2
        mid = (lo + hi) / 2
        below = 1 - np.exp(-mid) * (1 + mid) < u
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return exponential.astype(np.float32), lo.astype(np.float32)


EXPONENTIAL, GAMMA = _tables()


def _mix32(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def samples(ids: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SAMPLES consistent samples per non-empty text: 32 bits that stand for (shingle, level)."""
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.zeros((len(starts), SAMPLES), np.uint32)
    low, high = (ids & np.uint64(0xFFFFFFFF)).astype(np.uint32), (ids >> np.uint64(32)).astype(np.uint32)
    low = _mix32(low ^ (high * np.uint32(0x9E3779B1)))
    logw = np.log(weights).astype(np.float32)
    step = 1 << 15
    key = np.empty(len(ids), np.uint64)
    for k in range(SAMPLES):
        for a in range(0, len(ids), step):
            cut = slice(a, a + step)
            h = _mix32(low[cut] + np.uint32((2 * k + 1) * 0x9E3779B9 & 0xFFFFFFFF))
            g = _mix32(h ^ np.uint32((k + 1) * 0x85EBCA6B & 0xFFFFFFFF))
            r = GAMMA[h >> np.uint32(16)]
            beta = (h & np.uint32(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
            c = EXPONENTIAL[g >> np.uint32(16)] + EXPONENTIAL[g & np.uint32(0xFFFF)]
            level = np.floor(logw[cut] / r + beta)
            a_ = np.log(c) - r * (level - beta + np.float32(1))
            bits = a_.view(np.int32)
            bits = (bits ^ ((bits >> 31) & 0x7FFFFFFF)).astype(np.int64) + (1 << 31)
            name = low[cut] + level.astype(np.int32).view(np.uint32) * np.uint32(0x27D4EB2F)
            key[cut] = (bits.astype(np.uint64) << np.uint64(32)) | name
        out[:, k] = np.minimum.reduceat(key, starts).astype(np.uint32) if len(starts) else 0
    return out


def band_keys(found: np.ndarray) -> np.ndarray:
    """One 64-bit key per text and band."""
    out = np.zeros((len(found), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(found), b + 1, np.uint64)
        for r in range(ROWS):
            h = (h ^ found[:, b * ROWS + r]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out[:, b] = h
    return out.view(np.int64)


def signatures(docs: DataFrame, lift, id_col: str, text_col: str) -> DataFrame:
    """Per row: row number, doc_id, text key, number of shingles and band keys (none for a text without words)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("tk"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = rows.select("doc_id", "tk").schema.add("size", "long").add("bands", T.ArrayType(T.LongType()))

    def run(batches):
        for batch in batches:
            bands, total = [], []
            for part in groups(batch.column("text").to_pylist()):
                ids, counts, sizes = shingle_sets(part, WORDS)
                keys = band_keys(samples(ids, counts.astype(np.float32) * lift.value[bins(ids)], sizes))
                at, ends = np.cumsum(sizes > 0) - 1, np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(sizes)])]
                bands += [keys[i] if s else np.zeros(0, np.int64) for i, s in zip(at, sizes)]
                total.append(np.diff(ends))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tk"), pa.array(np.concatenate(total) if total else [], pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "tk", "size", "bands"])

    return keep(rows.mapInArrow(tidy(run), schema).withColumn("row", F.monotonically_increasing_id()), "dup-signatures")


def vectors(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """All shingles (node, ids; sorted, repeats included) of the nodes in ``wanted`` (node, tk); texts that can't be wanted stay where they are."""
    word = F.expr(f"shiftright(pmod(xxhash64(tk), {1 << FILTER_BITS}), 6)")
    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(tk), 64) as int))")
    mask = keep(wanted.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_mask")), "dup-filter")  # 2**18 rows at most
    texts = docs.select(text_key(text_col).alias("tk"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("_word", word)
    near = texts.join(F.broadcast(mask), "_word").filter(F.col("_mask").bitwiseAND(bit) != 0)
    one = near.groupBy("tk").agg(F.first("text").alias("text"))

    def run(batches):
        for batch in batches:
            nodes, at = batch.column("node"), 0
            for part in groups(batch.column("text").to_pylist()):
                ids, sizes = shingle_lists(part, WORDS)
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([nodes.slice(at, len(part)), pa.array([ids[e - n : e].tobytes() for e, n in zip(ends, sizes)], pa.binary())], names=["node", "ids"])
                at += len(part)

    return keep(one.join(wanted, "tk").select("node", "text").mapInArrow(tidy(run), "node long, ids binary"), "dup-vectors")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for all nodes in ``links`` (a, b): the least node that each can reach.

    Every step takes the least label of the neighbours, then the label's own label.
    """
    both = keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "dup-both")
    label = keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "dup-labels")
    while True:
        least = both.join(label.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        near = label.join(least, F.col("node") == F.col("a")).select("node", "comp", F.least("comp", "m").alias("to"))
        far = label.select(F.col("node").alias("to"), F.col("comp").alias("next"))
        new = keep(near.join(far, "to", "left").select("node", F.col("comp").alias("old"), F.least("to", "next").alias("comp")), "dup-labels")
        ended = not new.filter("old <> comp").limit(1).count()
        discard(label)
        label = new.select("node", "comp")
        if ended:
            discard(both)
            return label


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the least doc_id of its class), class_size, keep, tk.

    Exactly one row of a class has ``keep``: one with the least doc_id. Classes are the connected components of
    equal texts and of texts whose weighted Jaccard similarity is ``least`` or more.

    Defined cases: null and empty texts are equal texts; a text without words is in a class with equal texts
    only; a text of fewer than five words is one shingle; null doc_ids sort last in a class; repeated rows are
    members like others; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    counts, n = document_frequencies(docs, text_col)
    lift = spark.sparkContext.broadcast(bin_weights(counts, n))
    signed = signatures(docs, lift, id_col, text_col)
    nodes = keep(signed.groupBy("tk").agg(F.min("row").alias("node"), F.min_by(F.struct("size", "bands"), "row").alias("x")).select("tk", "node", "x.*"), "dup-nodes")
    banded = nodes.select("node", "tk", "size", F.posexplode("bands").alias("at", "key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key")
    buckets = keep(banded.join(shared, "key"), "dup-buckets")
    sets = vectors(docs, buckets.select("node", "tk").distinct(), text_col)
    comps = keep(spark.createDataFrame([], "node long, comp long"), "dup-comps")
    for turn in TURNS:
        comps = settle(buckets.filter(F.col("at").isin(*turn)).select("key", "node", "size"), comps, sets, lift, least)
    roots = nodes.select("tk", "node").join(comps, "node", "left").select("tk", F.coalesce("comp", "node").alias("root"))
    members = keep(signed.select("row", "doc_id", "tk").join(roots, "tk"), "dup-members")
    discard(buckets, sets, nodes, comps, signed)
    first = members.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("_first"))
    return members.join(first, "root").select("doc_id", "class_id", "class_size", (F.col("row") == F.col("_first.row")).alias("keep"), "tk")


def settle(buckets: DataFrame, comps: DataFrame, sets: DataFrame, lift, least: float, split: bool = True) -> DataFrame:
    """``comps`` (node, comp; only nodes that are not their component's name) after all pairs that share a bucket (key, node, size) are settled."""
    now = open_buckets(buckets, comps)
    comps = contract(comps, meet(_pieces(now), sets, lift, least))
    large = open_buckets(now.filter("pieces > 1").select("key", "node", "size"), comps)
    discard(now)
    sized = large.groupBy("key", "comp").agg(F.count("*").alias("_c"), F.sum("size").alias("_s"))
    most = sized.groupBy("key").agg(F.max_by(F.struct("comp", "_c", "_s"), F.struct("_c", "comp")).alias("_most"), F.sum("_c").alias("_n"), F.sum("_s").alias("_all"))
    few = most.select("key", F.col("_most.comp").alias("largest"), _cut(F.col("_n") - F.col("_most._c"), F.col("_all") - F.col("_most._s")).alias("few"))
    found, large = large, keep(large.join(few, "key"), "dup-large")
    discard(found)
    if not large.limit(1).count():
        return comps
    blocks = large.filter(F.col("few") <= MANY) if split else large
    comps = contract(comps, meet(_blocks(blocks), sets, lift, least))
    if split and (rest := large.filter(F.col("few") > MANY)).limit(1).count():
        comps = settle(prefixes(rest, sets, lift, least), comps, sets, lift, least, False)
    discard(large)
    return comps


def _cut(nodes, shingles):
    """Parts into which so many nodes with so many shingles are cut."""
    return F.greatest(F.ceil(nodes / F.lit(BLOCK)), F.ceil(shingles / F.lit(BLOCK_SHINGLES)), F.lit(1)).cast("int")


def open_buckets(buckets: DataFrame, comps: DataFrame) -> DataFrame:
    """The buckets that hold several components, with their nodes' components and the pieces they are cut into; of buckets with the same nodes one."""
    now = buckets.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    each = now.groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.count("*").alias("_n"), F.sum("size").alias("_s"), F.bit_xor(F.xxhash64("node")).alias("_x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("_y"))
    one = each.filter("_lo <> _hi").groupBy("_n", "_x", "_y").agg(F.min("key").alias("key"), F.min("_s").alias("_s"))
    return keep(now.join(one.select("key", _cut(F.col("_n"), F.col("_s")).alias("pieces")), "key"), "dup-open")


def _pieces(now: DataFrame) -> DataFrame:
    """(key, i, j, node, comp): all nodes in hashed pieces; every piece of a bucket that has several gets the bucket's leaders too."""
    pieces = now.select("key", F.pmod(F.xxhash64("node"), "pieces").cast("int").alias("i"), F.lit(0).alias("j"), "node", "comp")
    lead = [F.min(F.struct(F.xxhash64(F.lit(k), "node"), "node", "comp")) for k in range(LEADERS)]
    leaders = now.filter("pieces > 1").groupBy("key", "pieces").agg(F.array_distinct(F.array(*lead)).alias("x"))
    dealt = leaders.select("key", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("i"), "x").select("key", "i", F.lit(0).alias("j"), F.explode("x").alias("x"))
    return pieces.unionByName(dealt.select("key", "i", "j", "x.node", "x.comp"))


def _blocks(large: DataFrame) -> DataFrame:
    """(key, i, j, node, comp): blocks of nodes outside their bucket's largest component, each with every block of all nodes."""
    of = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    few = large.filter("comp <> largest").select("key", of("few").alias("i"), every("pieces").alias("j"), "node", "comp")
    return few.unionByName(large.select("key", every("few").alias("i"), of("pieces").alias("j"), "node", "comp"))


def prefixes(large: DataFrame, sets: DataFrame, lift, least: float) -> DataFrame:
    """Buckets (key, node, size), one for each of a large bucket's shingles that stands in the prefixes of two components' nodes.

    A set's prefix is what comes first of it, from rare to common, up to more than 1 - ``least`` of its weight. What two sets
    as similar as that share weighs ``least`` of either at least, so the first shingle they share lies in both prefixes.
    """
    whole = large.select("key", "node", "comp", "size").join(sets, "node")
    schema = "key long, node long, comp long, size long"

    def run(batches):
        for batch in batches:
            for key, node, comp, size, ids in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "comp", "size", "ids"))):
                ids = np.unique(np.frombuffer(ids, np.uint64), return_counts=True)
                weight = lift.value[bins(ids[0])]
                by = np.lexsort((ids[0], -weight))
                total = np.cumsum((weight * ids[1])[by].astype(np.float64))
                n = int(np.searchsorted(total, (1 - least) * total[-1] * (1 + 1e-6), side="right")) + 1 if len(total) else 0
                first = (mix64(ids[0][by[:n]].copy()) ^ np.array([key], np.int64).view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(first)] + [pa.array(np.full(len(first), x), pa.int64()) for x in (node, comp, size)], names=["key", "node", "comp", "size"])

    found = keep(whole.mapInArrow(tidy(run), schema), "dup-prefixes")
    several = found.groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).filter("_lo <> _hi").select("key")
    return found.join(several, "key").select("key", "node", "size")


def meet(dealt: DataFrame, sets: DataFrame, lift, least: float) -> DataFrame:
    """Links (a, b) between components whose nodes meet in a block (key, i, j) and are similar."""
    rows = dealt.join(sets, "node").select("key", "i", "j", "node", "comp", "ids")
    return rows.groupBy("key", "i", "j").applyInArrow(lambda t: _links(t, lift.value, least), "a long, b long").distinct()


def contract(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` after the components named in ``links`` are joined."""
    links = keep(links, "dup-links")
    if not links.limit(1).count():
        return comps
    joined = components(links).filter("node <> comp")
    moved = joined.select(F.col("node").alias("comp"), F.col("comp").alias("_to"))
    new = keep(comps.join(moved, "comp", "left").select("node", F.coalesce("_to", "comp").alias("comp")).unionByName(joined), "dup-comps")
    discard(links, comps, joined)
    return new


def _links(table: pa.Table, lift: np.ndarray, least: float) -> pa.Table:
    """All nodes of a block are compared; each component that gains links is linked to the least one of those it joins."""
    _, first = np.unique(table.column("node").to_numpy(), return_index=True)  # a leader may come twice
    names, group = np.unique(table.column("comp").to_numpy()[first], return_inverse=True)
    if len(names) < 2:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    column = table.column("ids")
    near = similar([np.frombuffer(column[i].as_buffer(), np.uint64) for i in first.tolist()], lift, least)
    label = group.copy()
    while True:
        best = np.where(near, label[None, :], len(names)).min(axis=1)
        to = np.arange(len(names))
        np.minimum.at(to, label, np.minimum(best, label))
        while (to[to] != to).any():
            to = to[to]
        if (to[label] == label).all():
            break
        label = to[label]
    of = np.zeros(len(names), np.int64)
    of[group] = label
    moved = np.flatnonzero(of != np.arange(len(names)))
    return pa.table({"a": pa.array(names[of[moved]], pa.int64()), "b": pa.array(names[moved], pa.int64())})


#: Shingles that at most so many of a block's nodes share are counted pair by pair, commoner ones by products of matrices of
#: so many columns.
RARE, COLUMNS = 12, 2048


def similar(sets: list[np.ndarray], lift: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of weighted sets (shingles, sorted, repeats included) have a weighted Jaccard similarity of ``least`` or more."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    owner, ids = np.repeat(np.arange(n), size), np.concatenate(sets)
    weight = lift[bins(ids)]
    total = np.bincount(owner, weight.astype(np.float64), n)
    # the k-th repeat of a shingle is a shingle of its own, so that the least of two counts is what both have
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (owner[1:] != owner[:-1])
    begun = np.flatnonzero(fresh)
    repeat = np.arange(len(ids)) - np.repeat(begun, np.diff(np.append(begun, len(ids))))
    key = ids.copy()
    again = repeat > 0
    key[again] ^= mix64(repeat[again].astype(np.uint64)) | np.uint64(1 << 63)
    by = np.argsort(key, kind="stable")
    key, owner, weight = key[by], owner[by], weight[by].astype(np.float64)
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(start, len(key)))
    shared = np.zeros((n, n))
    for c in np.unique(count[(count > 1) & (count <= RARE)]).tolist():
        a, b = np.triu_indices(c, 1)
        mine = start[count == c]
        for part in np.array_split(mine, -(-len(mine) * len(a) // (1 << 20))):
            pair = owner[part[:, None] + a] * n + owner[part[:, None] + b]
            shared += np.bincount(pair.ravel(), np.repeat(weight[part], len(a)), n * n).reshape(n, n)
    shared = shared + shared.T
    common = np.flatnonzero(count > RARE)
    for a in range(0, len(common), COLUMNS):
        part = common[a : a + COLUMNS]
        at = spread(start[part], count[part])
        matrix = np.zeros((n, len(part)), np.float32)
        matrix[owner[at], np.repeat(np.arange(len(part)), count[part])] = np.sqrt(weight[at])
        shared += matrix @ matrix.T
    both = total[:, None] + total[None, :] - shared
    near = shared >= least * both
    # what rounding could turn is worked out alone
    for x, y in zip(*np.nonzero(np.triu(np.abs(shared - least * both) <= 1e-4 * both, 1))):
        near[x, y] = near[y, x] = similarity(sets[x], sets[y], lift) >= least
    return near


def similarity(a: np.ndarray, b: np.ndarray, lift: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sets, given by their shingles with repeats."""
    (x, m), (y, n) = (np.unique(s, return_counts=True) for s in (a, b))
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    most = float((m * lift[bins(x)].astype(np.float64)).sum() + (n * lift[bins(y)].astype(np.float64)).sum())
    least = float((np.minimum(m[i], n[j]) * lift[bins(both)].astype(np.float64)).sum())
    return least / (most - least) if most > least else 0.0


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the row that ``classes`` keeps."""
    kept = keep(classes(docs, id_col, text_col, least).filter("keep").select(F.col("doc_id").alias("__ls_id"), F.col("tk").alias("__ls_tk")), "dup-kept")
    rows = docs.withColumn("__ls_key", text_key(text_col))
    same = (F.col("__ls_key") == F.col("__ls_tk")) & F.col(id_col).eqNullSafe(F.col("__ls_id"))
    out = rows.join(kept, same, "left_semi")
    # only rows that share both id and text are still repeated; that is looked up on narrow columns
    if rows.groupBy("__ls_key", id_col).count().filter("count > 1").limit(1).count():
        out = out.dropDuplicates([id_col, "__ls_key"])
    return out.drop("__ls_key")

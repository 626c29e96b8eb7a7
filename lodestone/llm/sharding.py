"""Sharding by balanced label propagation.

Rows are linked to the rows of their group (equal texts). A label is a shard. In each round a unit (a group, or
a piece of one that is too large for a quarter of a shard) votes: its most frequent label is where its rows want
to be; the pieces of a large group want to as few shards as can hold it, and small units make room for them there. How many rows may move from each shard to
each other one follows from the capacities: the matrix of wanted moves of linked rows, one number per pair of shards,
is scaled down until no shard would be overfull, and units are let through by a hash. Unlinked rows give way.
After the rounds, the rows above a shard's exact quota, unlinked ones first, fill the shards below theirs.
Votes are counted before they are shuffled, and a group is never joined with itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, text_key

#: A shard's order is cut into so many parts, which are ranked apart and then laid end to end.
PARTS = 1024
STEPS = 1 << 20


def allowed(moves: np.ndarray, sizes: np.ndarray, capacity: float) -> np.ndarray:
    """The wanted moves, inflows scaled down until every shard stays within its capacity."""
    x = moves.astype(float)
    np.fill_diagonal(x, 0)
    for _ in range(200):
        inflow, outflow = x.sum(axis=0), x.sum(axis=1)
        over = sizes + inflow - outflow - capacity
        if (over <= 0.5).all():
            break
        x *= np.where((over > 0) & (inflow > 0), np.maximum(0, 1 - over / np.maximum(inflow, 1)), 1.0)[None, :]
    return x


def homes(sizes: dict, pieces: dict, shards: int, quota: float) -> dict:
    """Shards for the pieces of large groups, largest group first, each where most room is left; (group, piece) to shard."""
    room, out = [quota] * shards, {}
    for group in sorted(sizes, key=lambda g: (-sizes[g], bytes(g))):
        share, shard = sizes[group] / pieces[group], None
        for piece in range(pieces[group]):
            if shard is None or room[shard] < share / 2:
                shard = max(range(shards), key=lambda s: (room[s], -s))
            room[shard] -= share
            out[group, piece] = shard
    return out


def _yielding(to: Column, free: np.ndarray) -> Column:
    """Where small units want to be once large groups have their homes: of those that want to a shard, the part that it has room for; the others, chosen by a hash, to where there is room."""
    if (free >= 1).all() or not free.any():
        return to
    stays, place = (F.pmod(F.xxhash64(F.lit(salt), "group", "piece"), F.lit(STEPS)) for salt in (7, 8))
    ends = (np.cumsum(free) / free.sum() * STEPS)[:-1]
    other = F.size(F.filter(F.array(*[F.lit(int(e)).cast("long") for e in ends]), lambda e: e <= place)) if len(ends) else F.lit(0)
    return F.when(stays < F.element_at(F.array(*[F.lit(int(f * STEPS)) for f in free]), to + 1), to).otherwise(other)


def propagate(rows: DataFrame, shards: int, rounds: int = 4, slack: float = 0.02) -> DataFrame:
    """Labels for ``rows`` (row, group, label, ...) after the rounds; adds ``linked``: rows of its unit that share its label.

    The driver sees one number per pair of shards and the keys of groups larger than a quarter of a shard,
    of which there are 4 * shards at most.
    """
    total = rows.count()
    if not total:
        return rows.withColumn("linked", F.lit(0).cast("long"))
    piece = max(1, total // (4 * shards))
    big = {r["group"]: r["n"] for r in rows.groupBy("group").agg(F.count("*").alias("n")).filter(F.col("n") > piece).collect()}
    pieces = {g: -(-n // piece) for g, n in big.items()}
    spark = rows.sparkSession
    cuts = spark.createDataFrame([(bytes(g), n) for g, n in pieces.items()], "group binary, _pieces int")
    planned = homes(big, pieces, shards, total / shards)
    home = spark.createDataFrame([(bytes(g), p, s) for (g, p), s in planned.items()], "group binary, piece long, _home int")
    free = np.full(shards, total / shards)
    for (g, _), s in planned.items():
        free[s] -= big[g] / pieces[g]
    free = np.clip(free * shards / total, 0, 1)
    rows = rows.join(F.broadcast(cuts), "group", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("row"), "_pieces"), F.lit(0)).cast("long")).drop("_pieces")
    rows = keep(rows, "shard-rows")

    def votes(now: DataFrame) -> DataFrame:
        counts = now.groupBy("group", "piece", "label").agg(F.count("*").alias("n"))
        return counts.groupBy("group", "piece").agg(
            F.sum("n").alias("_members"), F.max_by("label", F.struct("n", F.xxhash64("group", "label"))).alias("_to"), F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("_by")
        )

    for turn in range(rounds):
        wants = votes(rows).filter("_members > 1").join(F.broadcast(home), ["group", "piece"], "left").select("group", "piece", F.coalesce("_home", _yielding(F.col("_to"), free)).alias("_to"))
        joined = rows.join(wants, ["group", "piece"], "left").withColumn("_bound", F.col("_to").isNotNull()).withColumn("_to", F.coalesce("_to", "label"))
        joined = keep(joined, "shard-wants")
        moves, sizes = np.zeros((shards, shards)), np.zeros(shards)
        for r in joined.filter("_bound").groupBy("label", "_to").count().collect():
            moves[r["label"], r["_to"]] += r["count"]
            sizes[r["label"]] += r["count"]
        np.fill_diagonal(moves, 0)
        if not moves.any():
            break
        flow = allowed(moves, sizes, (1 + slack) * total / shards) / np.maximum(moves, 1)
        gate = F.element_at(F.array(*[F.lit(int(f * STEPS)) for f in flow.ravel()]), F.col("label") * shards + F.col("_to") + 1)
        goes = F.pmod(F.xxhash64(F.lit(turn), "group", "piece"), F.lit(STEPS)) < gate
        rows = joined.withColumn("label", F.when(goes, F.col("_to")).otherwise(F.col("label"))).drop("_to", "_bound")
    final = votes(rows).filter("_members > 1").select("group", "piece", "_by")
    out = rows.join(final, ["group", "piece"], "left")
    return out.withColumn("linked", F.coalesce(F.col("_by")[F.col("label")], F.lit(1)).cast("long")).drop("_by", "piece")


def cut_edges(rows: DataFrame, label: str = "shard", group: str = "text_crc32") -> DataFrame:
    """One row: ``links`` between rows of equal ``group``, and those that are ``cut``, whose ends have different labels.

    Links are counted from the sizes of groups and of their parts, never listed. Null groups are one group and null labels one label;
    an empty table has no links.
    """
    parts = rows.groupBy(F.col(group).alias("_group"), F.col(label).alias("_label")).agg(F.count("*").cast("decimal(19,0)").alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    each = parts.groupBy("_group").agg(pairs(F.sum("n")).alias("links"), F.sum(pairs(F.col("n"))).alias("kept"))
    one = each.agg(F.coalesce(F.sum("links"), F.lit(0)).cast("decimal(38,0)").alias("links"), F.coalesce(F.sum("kept"), F.lit(0)).cast("decimal(38,0)").alias("_kept"))
    return one.select("links", (F.col("links") - F.col("_kept")).alias("cut"))


def settle(rows: DataFrame, shards: int) -> DataFrame:
    """Exact quotas: ``shard`` and gapless ``slot`` for rows with a label; shard sizes differ by one row at most."""
    rows = keep(rows.withColumn("_p", F.when(F.col("linked") > 1, F.lit(0)).otherwise(F.lit(PARTS)) + F.pmod(F.xxhash64("row", F.lit(3)), F.lit(PARTS))), "shard-labels")
    counts = rows.groupBy("label", "_p").agg(F.count("*").alias("_n"))
    have = {r["label"]: int(r["n"]) for r in counts.groupBy("label").agg(F.sum("_n").alias("n")).collect()}
    total = sum(have.values())
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    above, below, spare, free = [], [], 0, []
    for s in range(shards):
        above.append(spare)
        spare += max(0, have.get(s, 0) - quota[s])
    filled = 0
    for s in range(shards):
        below.append(filled)
        need = max(0, quota[s] - have.get(s, 0))
        free += [(filled, need, s)] if need else []
        filled += need

    before = Window.partitionBy("label").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("label", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("label", "_p").orderBy("row")
    placed = rows.join(bases, ["label", "_p"]).withColumn("_rank", F.col("_base") + F.row_number().over(inside) - 1)

    def per_shard(values, index):
        return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), index + 1)

    mine = per_shard(quota, F.col("label"))
    spot = per_shard(above, F.col("label")) + F.col("_rank") - mine
    shard, slot = F.col("label"), F.col("_rank")
    for at, need, s in free:
        hit = (F.col("_rank") >= mine) & (spot >= at) & (spot < at + need)
        shard, slot = F.when(hit, F.lit(s)).otherwise(shard), F.when(hit, F.lit(have.get(s, 0) - at).cast("long") + spot).otherwise(slot)
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", slot.cast("long")).drop("label", "_p", "_base", "_rank", "linked")


def shard(docs: DataFrame, shards: int = 16, rounds: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null).

    Defined cases: a null text is empty (size 1, crc of no bytes, grouped with empty texts); null and repeated
    ids and equal rows are rows of their own; an empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), text_key(text_col).alias("group"))
    rows = keep(rows.withColumn("row", F.monotonically_increasing_id()), "shard-ids")
    rows = rows.withColumn("label", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    out = settle(propagate(rows, shards, rounds), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

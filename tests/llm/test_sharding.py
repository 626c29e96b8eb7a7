import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import sharding


def check(rows, got, shards=16):
    assert len(got) == len(rows)
    assert sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows) == sorted((str(g["doc_id"]), g["size"], g["text_crc32"]) for g in got)
    slots = defaultdict(list)
    for g in got:
        assert g["law"] == "rows" and g["grown_shard"] is None
        slots[g["shard"]].append(g["slot"])
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_groups_stay_together(spark, docs_schema):
    rows = [(i, f"text {i}" if i % 3 else f"group {i % 40}", "en", "a", 1) for i in range(1600)]
    df = spark.createDataFrame(rows, docs_schema)
    got = sharding.shard(df).collect()
    check(df.collect(), got)
    where = defaultdict(set)
    for g in got:
        where[g["text_crc32"]].add(g["shard"])
    assert sum(len(w) > 1 for w in where.values()) <= 2


def test_hot_group_fills_few_shards(spark, docs_schema):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i}", "en", "a", 1) for i in range(1600)]
    df = spark.createDataFrame(rows, docs_schema)
    got = sharding.shard(df).collect()
    check(df.collect(), got)
    held = Counter(g["shard"] for g in got if g["text_crc32"] == zlib.crc32(b"hot"))
    assert sum(sorted(held.values())[-8:]) >= 0.8 * 534  # a random deal has half in eight shards


def test_flows_respect_capacities():
    rng = np.random.default_rng(0)
    for _ in range(50):
        sizes = np.full(6, 100.0)
        moves = rng.integers(0, 20, (6, 6)).astype(float)
        moves[:, 2] *= 5
        np.fill_diagonal(moves, 0)
        x = sharding.allowed(moves, sizes, 110)
        assert (x <= moves + 1e-9).all() and (sizes + x.sum(axis=0) - x.sum(axis=1) <= 111).all()


def test_awkward_rows(awkward, clashing, empty):
    check(awkward.collect(), sharding.shard(awkward).collect())
    check(awkward.collect(), sharding.shard(clashing).collect())
    assert sharding.shard(empty).count() == 0


def test_cut_edges_are_counted_and_fall(spark, docs_schema):
    """Of a table with small, middling and hot groups: against all pairs, before and after the propagation."""
    rows = [(i, "hot" if i % 4 == 0 else f"group {i % 90}" if i % 3 else f"text {i}", "en", "a", 1) for i in range(1600)]
    df = spark.createDataFrame(rows, docs_schema)
    dealt = df.select("doc_id", F.crc32("text").alias("text_crc32"), F.pmod(F.xxhash64("doc_id"), F.lit(16)).alias("shard"))

    def brute(found):
        groups = defaultdict(list)
        for r in found:
            groups[r["text_crc32"]].append(r["shard"])
        pairs = [(a, b) for g in groups.values() for i, a in enumerate(g) for b in g[:i]]
        return len(pairs), sum(a != b for a, b in pairs)

    before, after = dealt.collect(), (done := sharding.shard(df)).collect()
    counted = [tuple(map(int, sharding.cut_edges(x).first())) for x in (dealt, done)]
    assert counted == [brute(before), brute(after)]
    # a group of a quarter of all rows needs four shards at least, which cuts three quarters of its links; the others need cut none
    hot = 400 * 399 // 2
    floor = hot - 4 * (100 * 99 // 2)
    assert floor <= counted[1][1] <= floor + 0.1 * (counted[1][0] - floor) and counted[0][1] > 0.9 * counted[0][0]


def test_cut_edges_of_awkward_tables(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), (None, None), (7, 1), (7, 1), (8, 3)], "text_crc32 long, shard int")
    assert tuple(map(int, sharding.cut_edges(rows).first())) == (4, 3)
    assert tuple(map(int, sharding.cut_edges(rows.limit(0)).first())) == (0, 0)

import math
import os
import random

import numpy as np
import pytest

from lodestone.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, label int"
BAD = [(900, None, 1), (901, [], 1), (902, [1.0, None, 0.0, 0.0], 1), (903, [1.0, float("nan"), 0.0, 0.0], 1), (904, [1.0, float("inf"), 0.0, 0.0], 1), (None, [1.0, 0.0, 0.0, 0.0], 1), (905, [1.0, 0.0], 1)]


def made(n, d=4, seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(d)], i % 3) for i in range(n)]
    return rows + [(n + i, list(rows[7][1]), 0) for i in range(20)]  # equal vectors


def brute(rows, score, k, asked):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in ok:
        if asked(q):
            best = sorted((score(qv, v), i) for i, v in ok if i != q)[:k]
            out += [(q, r, i, s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_exact_topk(spark):
    rows = made(700) + BAD
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(map(tuple, topk.exact_topk(df, df.filter("vec_id % 10 = 0"), k=7).collect()))
    want = brute(rows, lambda a, b: -int(np.floor(1024 * a) @ np.floor(1024 * b)), 7, lambda q: q % 10 == 0)
    assert got == [(q, r, i, -s) for q, r, i, s in want]


def test_topk_merging_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr("lodestone.llm.vectors.FAN_IN", 2)
    df = spark.createDataFrame(made(200), SCHEMA)
    few, many = (topk.exact_topk(d, d.filter("vec_id = 7")).collect() for d in (df.coalesce(1), df.repartition(9)))
    assert sorted(few) == sorted(many) and len(few) == 10


def test_topk_blocks_of_queries(spark, monkeypatch):
    df = spark.createDataFrame(made(200), SCHEMA)
    want = sorted(topk.exact_topk(df, df.filter("vec_id % 10 = 0")).collect())
    import lodestone.llm.vectors as v

    whole = v.blocks
    monkeypatch.setattr(topk, "blocks", lambda q: whole(q, 6))
    assert sorted(topk.exact_topk(df, df.filter("vec_id % 10 = 0")).collect()) == want


def test_topk_of_huge_components():
    a = np.array([[2.0**40, 3.0]])
    assert topk.products(a, np.array([[2.0**20, 5.0]])).tolist() == [[2**60 + 15]]


def test_few_rows_and_empty_tables(spark):
    df = spark.createDataFrame(made(20)[:2], SCHEMA)
    for f in (topk.exact_topk, ann.nearest):
        assert f(df, df).count() == 2 and f(df.limit(0), df).count() == 0 and f(df, df.limit(0)).count() == 0


def test_nearest_is_exact_at_full_depth(spark):
    rows = made(400) + BAD + [(906, [0.0] * 4, 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, ann.nearest(df, df.filter("vec_id % 10 = 0"), k=6, pivots=16, places=8, depth=1.0).collect()))
    want = brute([r for r in rows if r[0] != 906], lambda a, b: math.sqrt(((a - b) ** 2).sum()), 6, lambda q: q % 10 == 0)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=0)


def test_recall(spark):
    """Independent components, the hardest case: orders of pivots say least about them."""
    rng = np.random.default_rng(8)
    made = rng.normal(size=(6000, 64))
    made /= np.linalg.norm(made, axis=1)[:, None]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(made.astype(np.float32).tolist())], SCHEMA).repartition(3)
    found = ann.nearest(df, df.filter("vec_id % 100 = 0")).collect()
    rows = df.collect()
    m, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    hit = total = 0
    for q in [i for i in ids if i % 100 == 0]:
        far = np.sqrt(((m - m[ids == q]) ** 2).sum(axis=1))
        far[ids == q] = np.inf
        true = set(ids[np.lexsort((ids, far))[:10]])
        hit += len(true & {r["vec_id"] for r in found if r["query_id"] == q})
        total += 10
    assert hit / total >= 0.95


def test_footrule_ranks_as_defined():
    rng = np.random.default_rng(0)
    pivots, rows = rng.normal(size=(12, 5)), rng.normal(size=(40, 5))
    near = ann.orders(rows, pivots, 6)
    assert near.tolist() == [sorted(range(12), key=lambda p: ((r - pivots[p]) ** 2).sum())[:6] for r in rows]
    flat = near.ravel()
    by = np.argsort(flat, kind="stable")
    starts = np.searchsorted(flat[by], np.arange(13))
    for q in (3, 4, 5):
        mine = near[q][:4].tolist()
        want = [sum(abs(a - (r.index(p) if p in r else 6)) for a, p in enumerate(mine)) for r in near.tolist()]
        assert ann.footrule(near[q][:4], starts, by // 6, by % 6, 40, 6).tolist() == want


GIVEN = "/root/testdata/sf0.1/embeddings.parquet"


@pytest.mark.skipif(not os.path.exists(GIVEN), reason="needs the sample tables")
def test_recall_and_postings_on_the_given_table(spark, monkeypatch):
    """Five draws of pivots find 0.95 of the true neighbours, and no query reads a fifth of the postings."""
    df = spark.read.parquet(GIVEN)
    rows = ann.valid(df, "vec_id", "embedding").collect()
    m, ids = np.array([r["vector"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    true = {}
    for q in ids[ids % 100 == 0].tolist():
        far = np.sqrt(((m - m[ids == q]) ** 2).sum(axis=1))
        far[ids == q] = np.inf
        true[q] = set(ids[np.lexsort((ids, far))[:10]].tolist())
    hits, choose = [], ann.choose_pivots
    for draw in range(5):
        monkeypatch.setattr(ann, "choose_pivots", lambda rows, pivots, draw=draw: choose(rows, pivots, draw))
        found = ann.nearest(df, df.filter("vec_id % 100 = 0")).collect()
        hits.append(sum(r["vec_id"] in true[r["query_id"]] for r in found) / (10 * len(true)))
        pivots = choose(ann.valid(df, "vec_id", "embedding"), ann.PIVOTS, draw)[m.shape[1]]
        posted = np.bincount(ann.orders(m, pivots, ann.PLACES).ravel(), minlength=len(pivots))
        walked = posted[ann.orders(m[ids % 100 == 0], pivots, ann.WALKED)].sum(axis=1)
        assert walked.max() < posted.sum() / 5
    assert min(hits) >= 0.95, hits


def test_nearest_of_several_dimensions(spark, monkeypatch):
    """Each dimension has candidates of its own, with pivots or, where the sample missed it, without."""
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3 if i % 10 else 2 if i % 20 else 5)], 0) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = []
    for q, qv, _ in rows:
        if q % 5 == 0:
            own = sorted((math.dist(np.float32(qv).astype(float), np.float32(v).astype(float)), i) for i, v, _ in rows if i != q and len(v) == len(qv))[:4]
            want += [(q, r, i) for r, (_, i) in enumerate(own, 1)]
    ask = lambda: sorted(tuple(r)[:3] for r in ann.nearest(df, df.filter("vec_id % 5 = 0"), k=4, pivots=16, places=8, depth=1.0).collect())
    assert ask() == sorted(want)
    monkeypatch.setattr(ann, "LOOKED_AT", 1)
    few = ann.choose_pivots(ann.valid(df, "vec_id", "embedding"), 4)
    monkeypatch.setattr(ann, "choose_pivots", lambda rows, pivots: {3: few[3]})
    assert ask() == sorted(want)


def test_extra_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(made(50), SCHEMA)
    wide = df.select("*", *[F.lit("x").alias(c) for c in ("query", "query_id", "score", "rank", "part", "vector", "ids")])
    for f in (topk.exact_topk, ann.nearest):
        assert sorted(f(wide, wide.filter("vec_id < 5")).collect()) == sorted(f(df, df.filter("vec_id < 5")).collect())

"""Nearest rows of many queries, by tiles, against brute force."""

import math
import random

import duckdb
import pytest

from lodestone.functions import matrices
from lodestone.operators import dense
from lodestone.registry import ORACLE_SQL, QUERIES


def brute(rows, queries, k, digits):
    def score(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return None
        return sum(x * y for x, y in zip(a, b))

    def order(s, i):
        s = s if s is None or digits is None or not math.isfinite(s) else math.copysign(math.floor(abs(s) * 10**digits + 0.5), s) / 10**digits
        return (2, 0, i) if s is None else (0, 0, i) if math.isnan(s) else (1, -s, i)

    out = []
    for q, v in queries:
        found = sorted((order(score(v, w), i), i, score(v, w)) for i, w in rows if i != q)[:k]
        out += [(q, i, s, n) for n, (_, i, s) in enumerate(found, 1)]
    return sorted(out)


def told(rows):
    return [(a, b, None if c is None else repr(round(c, 9) + 0.0), d) for a, b, c, d in rows]


@pytest.mark.parametrize("digits", [None, 1, 5])
def test_nearest_is_exact_over_many_tiles(spark, monkeypatch, digits):
    monkeypatch.setattr(matrices, "TILE_QUERIES", 7)
    monkeypatch.setattr(matrices, "TILE_ROWS", 16)
    monkeypatch.setattr(dense, "CELLS", 120)
    r = random.Random(3)
    data = [(i, [r.choice([-0.5, 0.25, 0.0, 1.0, r.random()]) for _ in range(3)]) for i in range(200)] + [(1000 + i, [1.0, 1.0, 1.0]) for i in range(60)]
    rows = spark.createDataFrame(data, "id long, v array<double>")
    got = dense.nearest(rows.filter("id % 5 = 0"), rows, 4, "id", "id", "v", digits).collect()
    assert told(sorted(map(tuple, got))) == told(brute(data, [d for d in data if d[0] % 5 == 0], 4, digits))


def test_odd_vectors_come_last_or_first_as_they_sort(spark):
    nan, inf = float("nan"), float("inf")
    data = [("a", [1.0, 0.0]), ("b", None), ("c", [1.0, None]), ("d", [1.0]), ("e", [nan, 1.0]), ("f", [2.0, 1.0]), ("g", [inf, 1.0]), ("h", [-inf, 1.0]), ("i", []), (None, [9.0, 9.0])]
    rows = spark.createDataFrame(data, "id string, v array<double>")
    for k in (3, 20):
        got = dense.nearest(rows, rows, k, "id", "id", "v", 5).collect()
        named = [d for d in data if d[0] is not None]
        # an infinite component times zero is no number, in both
        assert told(sorted(map(tuple, got))) == told(brute(named, named, k, 5))
    assert dense.nearest(rows.limit(0), rows, 3, "id", "id", "v").count() == 0


def test_scores_of_copies_are_those_of_the_sql(spark, tmp_path):
    """A score is rounded once: 0.3889434997 is 0.388943, not 0.388944 by way of 0.388943500."""
    rows = spark.createDataFrame([(i, [1.0, 0.3889434997 if i else 0.0, 0.0 if i else 1.0]) for i in range(3)], "vec_id long, embedding array<float>")
    x = spark.createDataFrame([(0, [0.0, 1.0]), (1, [0.0, 0.38894349969])], "vec_id long, embedding array<double>")
    for name, df in (("floats", rows), ("doubles", x)):
        df.write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        got = QUERIES["knn_all_queries_top10"](spark, f"{tmp_path}/{name}").orderBy("query_id", "rank").collect()
        c = duckdb.connect()
        c.sql(f"create view embeddings as select * from '{tmp_path}/{name}/embeddings.parquet/*.parquet'")
        assert list(map(tuple, got)) == c.sql(ORACLE_SQL["knn_all_queries_top10"] + " ORDER BY query_id, rank").fetchall()


def test_measures_from_counts_are_those_from_listed_judgments(spark):
    from pyspark.sql import functions as F

    from lodestone.operators import evaluate

    r = random.Random(5)
    qrels = spark.createDataFrame([(q, i, r.choice([0, 1, 1, 2, 3])) for q in range(8) for i in range(r.choice([1, 5, 40]))], "query_id long, id long, grade int")
    ranked = spark.createDataFrame([(q, i, n) for q in range(9) for n, i in enumerate(r.sample(range(40), 15), 1)], "query_id long, id long, rank int")
    totals = qrels.groupBy("query_id", "grade").agg(F.count("*").alias("n"))
    got = evaluate.measured(ranked.join(qrels, ["query_id", "id"], "left"), totals)
    want = evaluate.metrics(ranked, qrels)
    flat = lambda df: sorted(tuple(round(x, 12) for x in row) for row in df.collect())
    assert flat(got) == flat(want) and got.count() > 3
    first = {row["query_id"]: row["ndcg"] for row in got.collect()}
    judged = {(row["query_id"], row["id"]): row["grade"] for row in qrels.collect()}
    for q, ndcg in first.items():
        ideal = sorted((g for (a, _), g in judged.items() if a == q), reverse=True)[:10]
        dcg = sum(judged.get((q, row["id"]), 0) / math.log2(row["rank"] + 1) for row in ranked.filter(f"query_id = {q} and rank <= 10").collect())
        assert abs(ndcg - dcg / sum(g / math.log2(n + 1) for n, g in enumerate(ideal, 1))) < 1e-12


def test_pair_summary_counts_all_pairs_but_a_querys_own(spark, monkeypatch):
    monkeypatch.setattr(matrices, "TILE_QUERIES", 7)
    monkeypatch.setattr(matrices, "TILE_ROWS", 16)
    monkeypatch.setattr(dense, "CELLS", 120)
    r = random.Random(4)
    data = [(i, [r.uniform(-1, 1) for _ in range(3)]) for i in range(150)]
    for extra in ([], [(900, None), (901, [1.0])]):
        rows = spark.createDataFrame(data + extra, "id long, v array<double>")
        got = dense.pair_summary(rows.filter("id % 5 = 0"), rows, "id", "id", "v").first()
        want = [sum(x * y for x, y in zip(v, w)) for i, v in data if i % 5 == 0 for j, w in data if i != j]
        asked = 30 + (1 if extra else 0)
        assert (got["pairs"], got["scored"]) == (asked * (149 + len(extra)), len(want)) and abs(got["total"] - sum(want)) < 1e-9 and abs(got["greatest"] - max(want)) < 1e-12


def test_no_evaluation_query_makes_a_row_of_every_pair(spark, tmp_path, monkeypatch):
    def never(*_, **__):
        raise AssertionError("all pairs")

    monkeypatch.setattr(dense, "scores", never)
    r = random.Random(6)
    rows = [(i, [r.gauss(0, 1) for _ in range(20)], i % 3) for i in range(120)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("knn_all_queries_top10", "recall_mrr_ndcg", "six_way_matrix", "paired_losses", "paired_deltas", "hard_negatives", "ranking_overlap"):
        assert QUERIES[name](spark, str(tmp_path)).count() > 0

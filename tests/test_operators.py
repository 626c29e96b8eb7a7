import json
import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import ids, text, vectors
from lodestone.operators import chunking, dense, evaluate, lexical, sampling, search, sync


def test_windows_over_text(spark):
    rows = spark.createDataFrame([("  α β γ δ  ", [5, 6, 7, 8], [(2, 4), (5, 7), (8, 10), (11, 13)])], "text string, ids array<int>, offsets array<struct<s:int,e:int>>")
    got = chunking.chunks(rows, 3, 1, ids_col="ids").orderBy("ordinal").collect()
    assert [g["chunk_text"] for g in got] == ["  α β γ ", "γ δ  "]
    assert got[1]["token_start"] == 2 and got[0]["model_ids"] == [0, 5, 6, 7, 2]
    assert chunking.chunks(rows.withColumn("offsets", F.slice("offsets", 1, 0)), 3, 1).count() == 0
    with pytest.raises(ValueError):
        chunking.chunks(rows, 3, 3)


def test_dense_order(spark):
    rows = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [1.0, 0.0]), ("c", [math.sqrt(0.5)] * 2)], "chunk_id string, embedding array<float>")
    got = dense.knn(rows, [1, 0], 3).collect()
    assert [g["chunk_id"] for g in got] == ["b", "c", "a"]
    assert [g["distance"] for g in got] == pytest.approx([0, 1 - math.sqrt(0.5), 1], abs=1e-6)


def test_scores_of_many_queries_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 3)]) for i in range(30)], "k long, v array<float>")
    one = sorted(map(tuple, dense.scores(rows, rows, "k", "k", "v").collect()))
    monkeypatch.setattr(dense, "QUERY_ROWS", 4)
    many = dense.scores(rows, rows, "k", "k", "v")
    assert "Cartesian" not in many._jdf.queryExecution().toString() and sorted(map(tuple, many.collect())) == one and len(one) == 900


def test_vector_expressions(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), (None,)], "v array<float>")
    got = rows.select(vectors.normalize("v").alias("n"), vectors.is_unit(vectors.normalize("v"), 2).alias("ok"), vectors.is_unit("v", 2).alias("raw")).collect()
    assert got[0]["n"] == pytest.approx([0.6, 0.8]) and got[0]["ok"] and not got[0]["raw"]
    assert [g["n"] for g in got[1:]] == [None] * 3 and not any(g["ok"] for g in got[1:])


def test_bm25_forms_agree(spark):
    rows = spark.createDataFrame([("a", "alpha beta alpha"), ("b", "beta gamma"), ("c", "alpha"), ("d", "Délta,alpha beta"), ("e", None)], "chunk_id string, text string")
    scan = {r[0]: r[1] for r in lexical.bm25(rows, lexical.query_phrases("delta gamma")).collect()}
    asked = spark.createDataFrame([(1, "delta gamma")], "q int, text string")
    index = lexical.postings(rows)
    many = {r["id"]: r["score"] for r in lexical.bm25_many(lexical.blocks(index, 5, 9), 5, asked, "q", "text", 10).collect()}
    assert scan == pytest.approx(many) and set(scan) == {"b", "d"}
    for query in ("delta gamma", "alpha-beta alpha", "beta beta nothing", "delta,alpha,beta"):
        indexed = {r[0]: r[1] for r in lexical.bm25_indexed(index, 5, 9, lexical.query_phrases(query)).collect()}
        assert indexed == pytest.approx({r[0]: r[1] for r in lexical.bm25(rows, lexical.query_phrases(query)).collect()}) and indexed
    assert lexical.bm25_indexed(index, 5, 9, []).count() == 0
    twice = {r[0]: r[1] for r in lexical.bm25(rows, lexical.query_phrases("delta delta")).collect()}
    assert twice["d"] == pytest.approx(2 * scan["d"])
    assert lexical.query_phrases("SQLITE_BUSY ... café") == [["sqlite", "busy"], ["cafe"]]
    assert {r[0]: r["tf"] for r in lexical.phrase_postings(lexical.postings(rows), ["alpha", "beta"]).collect()} == {"a": 1, "d": 1}
    assert {r[0] for r in lexical.bm25(rows, [["alpha", "beta"]]).collect()} == {"a", "d"}
    assert lexical.bm25(rows, []).count() == 0
    with pytest.raises(ValueError):
        lexical.query_phrases("  ")


def test_fusion_ties(spark):
    near = spark.createDataFrame([("a", 0.1), ("b", 0.2)], "chunk_id string, distance double")
    words = spark.createDataFrame([("b", -99.0), ("a", -1.0), ("c", -0.5)], "chunk_id string, score double")
    got = search.fuse(near, words, 10).orderBy("rank").collect()
    assert [g["chunk_id"] for g in got] == ["a", "b", "c"]
    assert got[0]["fusion_score"] == pytest.approx(1 / 61 + 1 / 62) and got[2]["distance"] is None


def test_scope_and_roots(spark):
    roots = spark.createDataFrame([("1", "x"), ("x", "y")], "id string, identity string")
    assert search.resolve_root(roots, "x").first()[0] == "x" and search.resolve_root(roots, "y").first()[0] == "x"
    rows = spark.createDataFrame([("a", "1", "t"), ("b", "x", "t")], "chunk_id string, source_root_id string, media_type string")
    assert search.scoped(rows, roots, "none").count() == 0 and search.scoped(rows, roots, "1", "t").count() == 1


def test_overlap_is_half_open(spark):
    rows = spark.createDataFrame([([(1, 0, 6), (2, 7, 19), (3, 19, 30)],)], "pages array<struct<page:int,byte_start:long,byte_end:long>>")
    assert [p["page"] for p in rows.select(search.overlapping(F.col("pages"), F.lit(0), F.lit(19)).alias("p")).first()["p"]] == [1, 2]


def test_metrics_known_answers(spark):
    ranked = spark.createDataFrame([(1, "x", 1), (1, "a", 2), (1, "b", 3)], "query_id int, id string, rank int")
    qrels = spark.createDataFrame([(1, "a", 1), (1, "b", 1)], "query_id int, id string, grade int")
    got = evaluate.metrics(ranked, qrels).first()
    assert got["recall"] == 1 and got["mrr"] == 0.5
    assert got["ndcg"] == pytest.approx((1 / math.log2(3) + 0.5) / (1 + 1 / math.log2(3)))


def test_top_ids_self_match(spark):
    rows = spark.createDataFrame([("q", "q", 1.0), ("q", "b", 0.5), ("q", "a", 0.5)], "query_id string, id string, score double")
    assert [r["id"] for r in dense.top_ids(rows).orderBy("rank").collect()] == ["a", "b"]
    assert [r["id"] for r in dense.top_ids(rows, exclude_self=False).orderBy("rank").collect()] == ["q", "a", "b"]


def test_seeded_rank_is_length_prefixed(spark):
    import hashlib

    want = hashlib.sha256(b"".join(len(p).to_bytes(8, "big") + p for p in (b"seed", b"query", "é1".encode()))).hexdigest()
    assert spark.createDataFrame([("é1",)], "id string").select(ids.seeded_rank("seed", "query", "id")).first()[0] == want


def test_digest_draws(spark):
    import hashlib

    def number(k):
        digest = hashlib.sha256(b"label\x007\0h\0" + (k // 4).to_bytes(8, "little")).digest()
        return int.from_bytes(digest[k % 4 * 8 :][:8], "little")

    got = evaluate.digest_draws(spark, ["label", "7", "h"], 10, 30).orderBy("replicate", "slot").collect()
    assert [tuple(r) for r in got] == [(k // 10, k % 10, number(k) % 10) for k in range(300)]
    with pytest.raises(ValueError):
        evaluate.digest_draws(spark, ["label", "7", "h"], 0, 1)


def test_digest_draws_leave_out_what_would_favour_low_positions(spark):
    import hashlib

    queries = (1 << 63) + 1  # nearly half of all numbers are rejected
    raw = [int.from_bytes(hashlib.sha256(b"x\0" + b.to_bytes(8, "little")).digest()[i : i + 8], "little") for b in range(17) for i in (0, 8, 16, 24)]
    fair = [x for x in raw if x < queries]
    assert 5 < len(fair) < len(raw)
    numbers = evaluate.digest_numbers(spark, ["x"], queries, 5).orderBy("at").collect()
    assert [int(r["number"]) for r in numbers] == fair[:5]


def test_sampling(spark):
    docs = spark.range(20).withColumnRenamed("id", "id")
    got = sampling.fill(docs, docs.filter("id < 3"), 8, "s")
    assert got.count() == 8 and got.filter("mandatory").count() == 3
    with pytest.raises(ValueError):
        sampling.fill(docs, docs, 8, "s")


def test_sync_outcomes(spark):
    old = spark.createDataFrame([("a", "1", None), ("b", "2", "m")], "document_id string, content_hash string, metadata string")
    new = spark.createDataFrame([("a", "1", None), ("b", "2", "n"), ("c", "3", None)], old.schema)
    assert {r[0]: r["outcome"] for r in sync.outcomes(old, new, ["content_hash", "metadata"]).collect()} == {"a": "unchanged", "b": "changed", "c": "new"}


def test_error_codes_first_match(spark):
    rows = spark.createDataFrame([("binary_input and size_limit",), ("other",)], "m string")
    assert [r[0] for r in rows.select(sync.error_code(F.col("m"))).collect()] == ["size_limit", "input_failed"]


def test_byte_slices(spark):
    assert spark.createDataFrame([("aβc",)], "t string").select(text.byte_slice("t", F.lit(1), F.lit(3))).first()[0] == "β"


def test_scores_of_more_queries_than_one_broadcast(spark, monkeypatch):
    from lodestone.operators import dense

    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(7)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(dense, "QUERY_ROWS", 3)
    got = sorted(map(tuple, dense.scores(rows, rows, "vec_id", "vec_id").collect()))
    assert got == [(q, i, float(q * i + 1)) for q in range(7) for i in range(7)]


def test_numbered_counts_over_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5)
    got = evaluate.numbered(rows, "k").collect()
    assert len(got) == 1000 and all(r["k"] == r["position"] for r in got) and evaluate.numbered(rows.limit(0), "k").count() == 0


def test_paired_replicates_draw_the_same_queries_for_all_arms(spark):
    values = spark.createDataFrame([(arm, q, float(q % 5) + shift) for arm, shift in (("x", 0.0), ("y", 0.5), ("z", -0.25)) for q in range(40)], "arm string, query_id long, v double")
    boot = evaluate.paired_bootstrap(values, "v", ["x", "y", "z"], 30).collect()
    assert len(boot) == 30 and len({r["x"] for r in boot}) > 5
    assert all(r["y"] - r["x"] == pytest.approx(0.5) and r["x"] - r["z"] == pytest.approx(0.25) for r in boot)
    (loss,) = evaluate.paired_losses(values, "v", ["x", "y"], ["z"], 30).collect()
    assert [loss["loss"], loss["low"], loss["high"]] == pytest.approx([0.75] * 3) and not loss["passes"]
    deltas = {r["arm"]: r["delta"] for r in evaluate.paired_deltas(values, "v", "x", ["y", "z"], 30).collect()}
    assert deltas == pytest.approx({"y": 0.5, "z": -0.25})
    with pytest.raises(ValueError, match="lacks"):
        evaluate.paired_bootstrap(values.filter("arm <> 'y' or query_id <> 3"), "v", ["x", "y"], 5)


def test_the_better_side_is_settled_in_each_replicate(spark):
    """Two sides that are better on different queries: the better of their means in a replicate is at least either one."""
    values = spark.createDataFrame([(a, q, v) for q in range(20) for a, v in (("x", float(q % 2)), ("y", float((q + 1) % 2)), ("m", 0.5))], "arm string, query_id long, v double")
    (got,) = evaluate.paired_losses(values, "v", ["x", "y"], ["m"], 200).collect()
    assert got["loss"] == pytest.approx(0) and got["low"] >= 0 and got["high"] > 0.05


def test_vector_differences_and_drift(spark):
    a = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.6, 0.8]), ("d", None), ("e", [1.0, 0.0]), ("only", [1.0, 0.0])], "chunk_id string, embedding array<float>")
    b = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [0.8, 0.6]), ("d", [1.0, 0.0]), ("e", [1.0])], "chunk_id string, embedding array<float>")
    rows = {r["chunk_id"]: r for r in evaluate.vector_differences(a, b).collect()}
    assert set(rows) == {"a", "b", "c"} and rows["b"]["cosine"] == pytest.approx(1) and (rows["b"]["difference"], rows["b"]["dimension"]) == (1.0, 1)
    got = evaluate.drift(evaluate.vector_differences(a, b)).first()
    assert (got["compared"], got["least_cosine_id"], got["greatest_difference_id"], got["dimension"]) == (3, "c", "b", 1) and got["least_cosine"] == pytest.approx(0.96)
    assert evaluate.drift(evaluate.vector_differences(a.limit(0), b)).first()["compared"] == 0
    sample = evaluate.drift_sample(evaluate.vector_differences(a, b), "s", "chunk_id", n=2).collect()
    assert len(sample) == 2 and sample[0]["hash"] < sample[1]["hash"]


def test_judgment_counts(spark):
    qrels = spark.createDataFrame([(1, 1, 2), (1, 2, 0), (2, 1, 0), (3, 1, 1)], "query_id int, id int, grade int")
    asked = spark.createDataFrame([(1,), (2,), (2,)], "query_id int")
    assert tuple(evaluate.judgment_counts(asked, qrels).first()) == (1, 2, 1)


def test_a_shortfall_of_hard_negatives_is_an_error(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1), (2, 11, 2)], "query_id int, id int, rank int")
    qrels = spark.createDataFrame([(1, 10, 1), (2, 11, 1)], "query_id int, id int, grade int")
    assert sampling.negatives_quota(ranked, qrels, 1).count() == 2
    with pytest.raises(ValueError, match="query 2 has 1 of 2"):
        sampling.negatives_quota(ranked, qrels, 2)


def test_locations_come_from_all_lists_of_the_metadata(spark):
    meta = '{"pages": [{"page": 1, "byte_start": 0, "byte_end": 10}, {"page": 2, "byte_start": 10, "byte_end": 20, "box": [1, {"a": "]"}]}, {"page": 3}, {"byte_start": 5.5, "byte_end": 19}, {"byte_start": -1, "byte_end": 19}], "cells": {"byte_start": 0, "byte_end": 99}, "locations": [{"byte_start": 19, "byte_end": 21, "kind": "x"}, 7]}'
    rows = spark.createDataFrame([(1, meta, 10, 20), (2, meta, 20, 21), (3, "{}", 0, 5), (4, None, 0, 5), (5, "no json", 0, 5), (6, '{"pages": [], "cells": null}', 0, 5)], "id int, m string, a long, b long")
    got = {r["id"]: [json.loads(x) for x in r["x"]] for r in rows.select("id", search.located(F.col("m"), F.col("a"), F.col("b")).alias("x")).collect()}
    assert [x.get("page", x.get("kind")) for x in got[1]] == [2, "x"] and got[1][0]["box"] == [1, {"a": "]"}]
    assert [x["kind"] for x in got[2]] == ["x"] and got[3] == got[4] == got[5] == got[6] == []


def test_a_budget_fails_the_list_at_the_first_result_that_passes_it(spark):
    rows = spark.createDataFrame([(2, "é" * 5, None), (1, "abc", "d"), (3, "", "")], "rank int, text string, uri string")
    assert [tuple(r) for r in search.charged(rows, 14, ("text", "uri")).select("rank", "bytes").orderBy("rank").collect()] == [(1, 4), (2, 14), (3, 14)]
    assert search.charged(rows, None, ("text", "uri")).count() == 3 and search.charged(rows.limit(0), 0, ("text",)).count() == 0
    with pytest.raises(Exception, match="response_limit"):
        search.charged(rows, 13, ("text", "uri")).select("rank").collect()


def test_all_mandatory_rows_stay_where_they_exceed_the_budget(spark, tmp_path):
    docs = spark.range(20).toDF("id")
    got = sampling.fill(docs, docs.filter("id < 12"), 8, "s", strict=False)
    assert sorted(map(tuple, got.collect())) == [(i, True) for i in range(12)]
    spark.range(900).selectExpr("id as doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(450).selectExpr("id as doc_id", "1 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    from lodestone.registry import QUERIES

    assert QUERIES["corpus_fill"](spark, str(tmp_path)).filter("mandatory").count() == 450

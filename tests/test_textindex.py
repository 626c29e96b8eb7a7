import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import shared
from lodestone.operators import lexical
from lodestone.plans import engine as engine_module
from lodestone.plans.store import Store, StoreError
from lodestone.plans.textindex import TextIndex, index_of
from test_engine import engine

QUERIES = ("alpha beta alpha", "SQLITE_BUSY", "the-common word gamma")


TABLES = "/root/testdata/sf0.01"


def scan(now, query):
    """Scores over the chunks' texts as they are."""
    return {r[0]: r[1] for r in lexical.bm25(now.table("chunks"), lexical.query_phrases(query)).collect()}


def indexed(now, query):
    return {r[0]: r[1] for r in lexical.bm25_indexed(now.live_postings(), *now.text_sums(), lexical.query_phrases(query)).collect()}


def same(now):
    for q in QUERIES:
        assert indexed(now, q) == pytest.approx(scan(now, q)), q


@pytest.fixture
def tree(tmp_path):
    top = tmp_path / "in"
    top.mkdir()
    (top / "a.txt").write_text("alpha beta gamma delta epsilon zeta eta theta alpha beta kappa")
    (top / "b.md").write_text("SQLITE_BUSY the common word")
    (top / "c.txt").write_text("the common, word. the-common word beta")
    return top


def test_index_follows_every_sync(spark, tmp_path, tree, monkeypatch):
    monkeypatch.setattr(engine_module, "FAN", 3)
    e = engine(spark, tmp_path / "store")
    e.ingest([str(tree)])
    first = e.store.snapshot()
    same(first)
    assert any(scan(first, q) for q in QUERIES)
    (tree / "a.txt").write_text("alpha only, gamma")
    e.ingest([str(tree)])
    second = e.store.snapshot()
    same(second)
    assert first.table("removed").count() == 0 and second.table("removed").count() == 1
    same(first)  # a pinned state stays as it was
    (tree / "a.txt").write_text("alpha beta gamma delta epsilon zeta eta theta alpha beta kappa")  # the first text again
    (tree / "b.md").unlink()
    e.ingest([str(tree)])
    same(e.store.snapshot())
    for i in range(2):
        (tree / f"n{i}.txt").write_text(f"alpha number{i} beta")
        e.ingest([str(tree)])
        same(e.store.snapshot())
    now = e.store.snapshot().manifest
    assert 1 <= len(now["tables"]["postings"]) <= 3 and set(now["tables"]["postings"]) == set(now["segments"])
    other = tmp_path / "other.txt"
    other.write_text("alpha of another root")
    e.ingest([str(other)])
    same(e.store.snapshot())
    e.remove("file://" + str(tree))
    same(e.store.snapshot())
    assert e.store.snapshot().text_sums() == (1, 4) and [r["uri"] for r in e.search("alpha", "lexical").collect()] == ["file://" + str(other)]


def test_void_postings_are_dropped_by_a_full_merge(spark, tmp_path, tree):
    e = engine(spark, tmp_path / "store")
    e.ingest([str(tree)])
    for i in range(3):
        for name in ("a.txt", "b.md", "c.txt"):
            (tree / name).write_text(f"alpha turn {i}")
        e.ingest([str(tree)])
        same(e.store.snapshot())
    now = e.store.snapshot()
    assert now.table("removed").count() == 0 and now.table("postings").count() == now.live_postings().count() == 9


def test_scores_read_postings_of_the_words_only(spark, tmp_path, tree):
    e = engine(spark, tmp_path / "store")
    e.ingest([str(tree)])
    now = e.store.snapshot()
    scored = lexical.bm25_indexed(now.live_postings(), *now.text_sums(), [["alpha"]])
    assert {f.split("/store/")[1].split("/")[0] for f in scored.inputFiles()} == {"postings"}
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "positions" not in plan and "EqualTo(term,alpha)" in plan
    assert "positions" in lexical.bm25_indexed(now.live_postings(), *now.text_sums(), [["a", "b"]])._jdf.queryExecution().executedPlan().toString()


def older(store, version=2):
    """The state as the version before wrote it: no index, no sums."""
    now = store.snapshot().manifest
    tables = {k: v for k, v in now["tables"].items() if k not in ("postings", "removed")}
    store._swap({k: v for k, v in now.items() if k not in ("sums", "segments")} | {"schema_version": version}, tables)


def test_migration_makes_the_index_and_goes_on_where_it_stopped(spark, tmp_path, tree, monkeypatch):
    e = engine(spark, tmp_path / "store")
    e.ingest([str(tree / n) for n in ("a.txt", "b.md", "c.txt")])
    want = {q: scan(e.store.snapshot(), q) for q in QUERIES}
    older(e.store)
    old = e.store.snapshot().manifest
    with pytest.raises(StoreError, match="migrate"):
        e.search("alpha", "lexical")
    derived, done = Store._derived, []

    def stops(self, now, root, segment):
        if len(done) == stop:
            raise RuntimeError("stopped")
        done.append(root)
        return derived(self, now, root, segment)

    monkeypatch.setattr(Store, "_derived", stops)
    for stop in (0, 1, 2):
        with pytest.raises(RuntimeError):
            e.store.migrate()
        assert e.store.snapshot().manifest == old and e.status()["chunks"] == 4
    monkeypatch.setattr(Store, "_swap", lambda *_: (_ for _ in ()).throw(RuntimeError("stopped")))
    stop = 9
    with pytest.raises(RuntimeError):
        e.store.migrate()
    assert e.store.snapshot().manifest == old
    monkeypatch.undo()
    assert e.store.migrate() and not e.store.migrate() and len(done) == len(set(done)) == 3
    now = e.store.snapshot()
    assert {q: indexed(now, q) for q in QUERIES} == {q: pytest.approx(w) for q, w in want.items()}
    assert e.search("alpha", "lexical").count() == 2
    (tree / "a.txt").write_text("alpha")
    e.ingest([str(tree / "a.txt")])
    same(e.store.snapshot())


def test_migration_that_does_not_account_for_all_is_refused(spark, tmp_path, tree, monkeypatch):
    e = engine(spark, tmp_path / "store")
    e.ingest([str(tree)])
    older(e.store)
    made = lexical.postings
    monkeypatch.setattr(lexical, "postings", lambda *a, **b: made(*a, **b).filter("term <> 'alpha'"))
    with pytest.raises(StoreError, match="account"):
        e.store.migrate()
    assert e.store.snapshot().manifest["schema_version"] == 2


def corpus(spark, rows=600, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(400)], k=rng.randrange(1, 60))) for _ in range(rows)]
    texts[:5] = ["w0 w1 w2", "w0 w1 w2", None, "", "w399 w0"]
    return spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string"), texts


@pytest.mark.parametrize("k", [1, 5, 50])
def test_many_queries_equal_all_pairs_and_meet_fewer_rows(spark, tmp_path, k):
    rows, texts = corpus(spark)
    rng = random.Random(k)
    asked = [(i, " ".join(rng.sample([t for t in texts if t], 1)[0].split()[:25])) for i in range(20)] + [(20, "w0 w1 w0"), (21, "nothing known"), (22, ""), (23, None), (24, "w399 w398 w397 w0 w1 w2")]
    asked = spark.createDataFrame(asked, "q long, text string")
    index = TextIndex.write(rows, str(tmp_path / "index"))
    got = index.bm25_many(asked, "q", "text", k)
    # all postings of all terms of all queries
    terms = lexical.query_terms(asked, "q", "text")
    held = index.postings()
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    part = F.col("times") * lexical.idf(F.lit(index.rows), F.col("df")) * lexical.weight(F.col("tf"), F.col("dl"), F.lit(index.length / index.rows))
    full = terms.join(df, "term").join(held, "term").groupBy("query_id", F.col("chunk_id").alias("id")).agg((-F.sum(part)).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9), "id")
    want = full.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    listed = lambda df: [(r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in df.orderBy("query_id", "rank").collect()]
    assert listed(got) == listed(want)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no sample tables")
def test_bounds_spare_most_of_the_rows(spark):
    """Whole documents against all benchmark passages: needed postings, and candidates times the other terms, against all postings of all terms."""
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    index = index_of(docs)
    terms = lexical.query_terms(spark.read.parquet(f"{TABLES}/benchmark.parquet"), "item_id", "text")
    held = shared.kept(index.blocks().groupBy("term").agg(F.sum("df").alias("df")), "test-df")
    bounded = shared.kept(lexical.bounded_terms(index.blocks(), index.rows, terms, 5), "test-terms")
    found = lexical.candidates(index.blocks(), bounded, 5)
    met = bounded.filter("needed").join(held, "term").agg(F.sum("df")).first()[0] + found.join(bounded.filter("not needed"), "query_id").count()
    everything = terms.join(held, "term").agg(F.sum("df")).first()[0]
    print("rows met:", met, "of", everything)
    assert met < 0.6 * everything


def test_a_frequent_term_is_dealt(spark):
    rows = spark.range(6000).select(F.col("id").alias("chunk_id"), F.concat(F.lit("common w"), F.col("id") % 50).alias("text"))
    held = shared.kept(lexical.blocks(lexical.postings(rows), 6000, 12000), "test-blocks")
    share = [r["n"] for r in held.filter("term = 'common'").groupBy((F.col("block") % lexical.WAYS).alias("way")).agg(F.sum("df").alias("n")).collect()]
    assert len(share) == lexical.WAYS and max(share) < 2 * sorted(share)[len(share) // 2]


def test_index_of_a_table_is_made_anew_when_its_files_change(spark, tmp_path):
    at = str(tmp_path / "texts")
    rows, _ = corpus(spark, 40)
    rows.write.parquet(at)
    one = index_of(spark.read.parquet(at))
    assert index_of(spark.read.parquet(at)) is one and one.rows == 40
    rows.withColumn("chunk_id", F.col("chunk_id") + 100).write.mode("append").parquet(at)
    assert index_of(spark.read.parquet(at)).rows == 80
    plan = one.bm25([["w1"]])._jdf.queryExecution().executedPlan().toString()
    assert "part#" in plan.split("PartitionFilters: ")[1].split("]")[0]
    empty = TextIndex.write(rows.limit(0), str(tmp_path / "none"))
    assert (empty.rows, empty.length) == (0, 0) and empty.bm25([["w0"]]).count() == 0 and empty.bm25_many(rows.limit(3), "chunk_id", "text", 5).count() == 0


def test_few_asked_terms_leave_the_entries_where_they_are(spark, monkeypatch):
    """More terms than one broadcast holds meet the entries by shuffles, with the same parts."""
    rows = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 5}" for j in range(1, 9))) for i in range(300)], "chunk_id long, text string")
    held = shared.kept(lexical.blocks(lexical.postings(rows), 300, 2400), "test-asked")
    asked = spark.createDataFrame([(q, f"w{q % 5}", 1.0 + q) for q in range(8)], "query_id long, term string, gain double")
    few = lexical.scored_entries(asked, held)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(lexical, "ASKED_ROWS", 0)
    many = lexical.scored_entries(asked, held)
    flat = lambda df: sorted((a, b, round(c, 9)) for a, b, c in df.collect())
    assert flat(few) == flat(many) and few.count() > 300


def test_blocks_are_written_when_asked_for_and_without_a_shuffle(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"a b{i % 7} a") for i in range(900)], "chunk_id long, text string")
    index = TextIndex.write(rows, f"{tmp_path}/index")
    assert not os.path.exists(f"{tmp_path}/index/blocks")
    assert "Exchange" not in lexical.blocks(index.postings(), index.rows, index.length)._jdf.queryExecution().executedPlan().toString()
    told = {r["term"]: r["n"] for r in index.blocks().groupBy("term").agg(F.sum("df").alias("n")).collect()}
    assert told == {"a": 900} | {f"b{i}": len(range(i, 900, 7)) for i in range(7)} and os.path.exists(f"{tmp_path}/index/blocks")

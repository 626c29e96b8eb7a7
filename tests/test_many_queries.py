import os
import random

import duckdb
import pytest

from lodestone.operators import lexical
from lodestone.plans import catalogue_search, textindex
from lodestone.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "/root/testdata/sf0.01"


def put(spark):
    """Bytes shuffled, spilled and written so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    gateway = spark.sparkContext._gateway
    stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in map(stages.apply, range(stages.size())))


def listed(df):
    return [(r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in sorted(df.collect(), key=lambda r: (str(r["query_id"]), r["rank"]))]


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no sample tables")
def test_less_is_put_on_disk_than_is_read(spark):
    """The index and the entries of opened blocks were twelve times the documents."""
    before = put(spark)
    got = QUERIES["bm25_benchmark_queries"](spark, TABLES).toPandas()
    assert put(spark) - before < 0.6 * os.path.getsize(f"{TABLES}/documents.parquet")
    c = duckdb.connect()
    for name in ("documents", "benchmark"):
        c.sql(f"create view {name} as select * from '{TABLES}/{name}.parquet'")
    want = c.sql(ORACLE_SQL["bm25_benchmark_queries"]).df()
    rows = lambda df: sorted(map(tuple, df[["query_id", "id", "rank", "score"]].itertuples(index=False)))
    assert len(want) == 200 and rows(got) == rows(want)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(200)], k=rng.randrange(1, 40))) for _ in range(300)]
    texts[:6] = ["w0 w1 w2", "w0 w1 w2", None, "", "w199 w0", "... !"]
    texts[100:160] = ["w3 w5 w3"] * 60  # more equal rows than any list holds
    asked = [(i, " ".join(rng.sample([t for t in texts if t], 1)[0].split()[:25])) for i in range(12)]
    return texts, [*asked, (12, "w0 w1 w0"), (13, "nothing known"), (14, ""), (15, None), (16, "w199 w198 w0"), (17, "w3 W5"), (18, "wÁ w3 w3")]


@pytest.mark.parametrize(("k", "met", "kind"), [(1, 1, "long"), (5, 700, "long"), (50, 1 << 20, "string"), (400, 1, "string")])
def test_equal_to_blocks_however_it_is_cut(spark, monkeypatch, k, met, kind):
    texts, asked = corpus(k)
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").repartition(3).selectExpr(f"cast(chunk_id as {kind}) as chunk_id", "text")
    asked = spark.createDataFrame(asked, "q long, text string")
    monkeypatch.setattr(lexical, "MET", met)
    got = lexical.bm25_of_queries(rows, asked, "q", "text", k)
    assert got.columns == ["query_id", "id", "score", "rank"] and got.schema["id"].dataType == rows.schema["chunk_id"].dataType
    got = listed(got)
    index = textindex.TextIndex.write(rows, textindex.shared.new_folder(spark, "test-index"))
    assert got == listed(index.bm25_many(asked, "q", "text", k)) and len({g[0] for g in got}) == 16


def test_more_words_take_more_passes(spark, monkeypatch):
    texts, asked = corpus(3)
    rows, asked = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string"), spark.createDataFrame(asked, "q long, text string")
    want, once, asked_in = listed(lexical.bm25_of_queries(rows, asked, "q", "text", 5)), lexical.bm25_asked, []
    monkeypatch.setattr(lexical, "ASKED_ROWS", 90)
    monkeypatch.setattr(lexical, "bm25_asked", lambda rows, asked, *a: asked_in.append(asked.num_rows) or once(rows, asked, *a))
    assert listed(lexical.bm25_of_queries(rows, asked, "q", "text", 5)) == want
    assert len(asked_in) > 1 and sum(asked_in) == lexical.query_terms(asked, "q", "text").count()


def test_nothing_asked_and_nothing_held(spark):
    rows = spark.createDataFrame([(1, "a b"), (None, "b"), (3, None), (4, "b")], "chunk_id long, text string")
    asked = spark.createDataFrame([(None, "b b"), (7, "a"), (8, "c")], "q string, text string")
    assert [(q, n, i) for q, n, i, _ in listed(lexical.bm25_of_queries(rows, asked, "q", "text", 9))] == [("7", 1, 1), (None, 1, 4), (None, 2, None), (None, 3, 1)]
    for texts, queries in ((rows, asked.limit(0)), (rows.limit(0), asked), (rows.filter("text is null"), asked), (rows, asked.filter("q = '8'"))):
        assert lexical.bm25_of_queries(texts, queries, "q", "text", 5).count() == 0


def test_the_query_makes_no_index(spark, monkeypatch):
    monkeypatch.setattr(catalogue_search, "index_of", lambda *_: pytest.fail("an index"))
    assert QUERIES["bm25_benchmark_queries"](spark, "/root/testdata/sf0.001").count() > 0

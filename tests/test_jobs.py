"""Both jobs: as registered queries against SQL, over growing input, after failures, and from the command line."""

import hashlib
import json
import os
import random
import re
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import evaluate_retrieval, index_documents, queries
from test_oracle import FOLDER, rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, segment string"
CONFIG = index_documents.configuration()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in ("documents", "benchmark"):
        c.sql(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no sample tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, duck, name):
    before = dict(spark.conf.getAll)
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    want = duck.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want) and len(got)
    assert before == dict(spark.conf.getAll)


class Growing:
    """A folder of documents, and the index over it."""

    def __init__(self, spark, at):
        self.spark, self.source, self.output, self.mark = spark, str(at / "in"), str(at / "out"), str(at / "mark")

    def add(self, *docs):
        full = [(i, t, "en", s, 0, "clash") for i, t, s in docs]
        self.spark.createDataFrame(full, SCHEMA).coalesce(1).write.mode("append").parquet(self.source)

    def run(self):
        return index_documents.run(self.spark, self.source, self.output, self.mark, CONFIG)

    def live(self):
        schemas = index_documents.schemas_of(self.spark.read.parquet(self.source), CONFIG)
        return sorted(tuple(r) for r in index_documents.live(self.spark, self.output, schemas).select("doc_id", "term", "dl", "tf", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",")).collect())

    def files(self):
        return {os.path.join(d, f) for d, _, names in os.walk(self.output) for f in names if f.endswith(".parquet")}


def postings(docs):
    out = []
    for i, t in docs.items():
        words = re.findall(r"\w+", (t or "").lower())
        for w in set(words):
            at = [k for k, x in enumerate(words) if x == w]
            out.append((i, w, len(words), len(at), ",".join(map(str, at))))
    return sorted(out)


def test_index_takes_only_what_is_new(spark, tmp_path):
    g = Growing(spark, tmp_path)
    g.add((1, "Alpha beta alpha", "a"), (2, "gamma", "b"), (3, None, None), (4, "", "b"), (None, "no id", "a"))
    first = g.run()
    assert [(b["segment"], b["read"], b["without_id"], b["documents"], b["postings"]) for b in first] == [(0, 5, 1, 4, 3)]
    state = {1: "Alpha beta alpha", 2: "gamma"}
    assert g.live() == postings(state)
    files = g.files()
    assert g.run() == [] and g.files() == files
    g.add((2, "delta gamma", "b"), (1, "Alpha beta alpha", "a"), (5, "alpha", "c"))
    g.add((5, "alpha", "c"), *[(6, "the same", "a")] * 50)
    second = g.run()
    assert [(b["segment"], b["read"], b["documents"], b["postings"]) for b in second] == [(1, 54, 3, 5)]
    assert g.live() == postings(state | {2: "delta gamma", 5: "alpha", 6: "the same"})
    assert files < g.files()  # what was there is as it was
    g.add((2, "gamma", "b"), (6, "", "a"))  # back to an earlier text, and none any more
    assert [(b["segment"], b["documents"]) for b in g.run()] == [(2, 2)]
    assert g.live() == postings(state | {5: "alpha"})


@pytest.mark.parametrize("stage", [1, 2])
def test_a_batch_that_failed_runs_again(spark, tmp_path, monkeypatch, stage):
    g = Growing(spark, tmp_path)
    g.add((1, "alpha beta", "a"))
    g.run()
    g.add((1, "beta", "a"), (2, "gamma", "a"))
    write, calls = index_documents._overwrite, []

    def fails(rows, folder):
        calls.append(folder)
        if stage == 2:
            write(rows, folder)
        if len(calls) == stage:
            raise RuntimeError("lost")
        if stage == 1:
            write(rows, folder)

    monkeypatch.setattr(index_documents, "_overwrite", fails)
    with pytest.raises(Exception, match="lost"):
        g.run()
    monkeypatch.undo()
    if stage == 1:
        assert g.live() == postings({1: "alpha beta"})
    assert [(b["segment"], b["documents"], b["postings"]) for b in g.run()] == [(1, 2, 2)]
    assert g.live() == postings({1: "beta", 2: "gamma"}) and g.run() == []


def test_no_documents_at_all(spark, tmp_path):
    g = Growing(spark, tmp_path)
    g.add()
    assert all(b["documents"] == 0 for b in g.run()) and g.live() == []


def test_evaluation_reruns_to_the_same(spark, tmp_path):
    docs = [(1, "one two three four", "en", "a", 0, ""), (2, "zero one two three", "en", "b", 0, ""), (3, "two one three", "en", None, 0, ""), (4, None, "en", "a", 0, ""), (None, "one two three", "en", "a", 0, "")]
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "docs"))
    spark.createDataFrame([(7, "one two three"), (8, "unknown"), (9, None), (None, "two"), (10, "Four!")], "item_id long, text string").write.parquet(str(tmp_path / "asked"))
    config = evaluate_retrieval.configuration() | {"negatives": 2}
    results = []
    for _ in range(2):
        counts = evaluate_retrieval.run(spark, str(tmp_path / "docs"), str(tmp_path / "asked"), str(tmp_path / "out"), config)
        assert counts == {"documents": 4, "queries": 4, "ranking": 4, "metrics": 2}
        results.append([sorted(map(str, spark.read.parquet(str(tmp_path / "out" / n)).collect())) for n in ("ranking", "metrics")])
    assert results[0] == results[1]
    got = {r["id"]: r for r in spark.read.parquet(str(tmp_path / "out" / "ranking")).filter("query_id = 7").collect()}
    assert {i: (r["relevant"], r["negative"], r["source"]) for i, r in got.items()} == {1: (True, 0, "a"), 2: (True, 0, "b"), 3: (False, 1, None)}
    measures = {r["query_id"]: r for r in spark.read.parquet(str(tmp_path / "out" / "metrics")).collect()}
    assert (measures[7]["hits"], measures[7]["recall"], measures[7]["shortfall"], str(measures[7]["judged"])) == (2, 1.0, 1, "true")
    assert measures[10]["mrr"] == 1.0 and measures[10]["shortfall"] == 2


def test_command_line(tmp_path, spark):
    g = Growing(spark, tmp_path)
    g.add((1, "alpha beta", "a"))
    config = tmp_path / "own.json"
    config.write_text(json.dumps(CONFIG | {"kept": []}))
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-m", "jobs.index_documents", "--documents", g.source, "--output", g.output, "--checkpoint", g.mark, "--config", str(config)], cwd=top, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "wrote 1 documents and 2 postings" in done.stderr, done.stderr[-2000:]
    assert index_documents.main.__module__ == "jobs.index_documents"
    with pytest.raises(SystemExit):
        index_documents.main([])
    with pytest.raises(SystemExit):
        evaluate_retrieval.main(["--documents", "x"])


def moved(spark):
    """Bytes shuffled and spilled so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    gateway = spark.sparkContext._gateway
    stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() + stages.apply(i).diskBytesSpilled() for i in range(stages.size()))


def test_texts_are_shuffled_once_and_postings_never(spark, tmp_path):
    g, r = Growing(spark, tmp_path), random.Random(3)
    texts = [" ".join(f"{r.getrandbits(40):x}" for _ in range(300)) for _ in range(500)]
    g.add(*[(i, t, "a") for i, t in enumerate(texts)])
    before = moved(spark)
    g.run()
    assert g.live() == postings(dict(enumerate(texts)))
    assert moved(spark) - before < 1.3 * sum(map(len, texts))


@pytest.mark.parametrize("most", [0, 1 << 18])
def test_replaced_documents_stay_out_however_many(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(index_documents, "MOST_VOID", most)
    g = Growing(spark, tmp_path)
    for text in ("alpha beta", "beta gamma", "beta beta"):
        g.add((1, text, "a"), (2, "delta", "a"), (3, text + " more", "b"))
        g.run()
    assert g.live() == postings({1: "beta beta", 2: "delta", 3: "beta beta more"})


def test_postings_count_once_their_documents_are_written(spark, tmp_path, monkeypatch):
    g = Growing(spark, tmp_path)
    g.add((1, "alpha", "a"))
    g.run()
    g.add((1, "beta", "a"), (2, "gamma", "a"))
    write = index_documents._overwrite

    def fails(rows, folder):
        if folder.endswith("documents"):
            raise RuntimeError("lost")
        write(rows, folder)

    monkeypatch.setattr(index_documents, "_overwrite", fails)
    with pytest.raises(Exception, match="lost"):
        g.run()
    monkeypatch.undo()
    assert g.live() == postings({1: "alpha"})
    g.run()
    assert g.live() == postings({1: "beta", 2: "gamma"})


def test_each_row_of_a_long_file_is_chosen_for_itself(spark, tmp_path):
    g, n = Growing(spark, tmp_path), 2 * index_documents.BITS + 9
    made = spark.range(n).select(F.when(F.col("id") % 1000 != 7, F.col("id")).alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 5).alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(0).alias("n_chars"), F.lit("").alias("segment"))
    again = made.filter("doc_id % 3 = 0").withColumn("text", F.lit("x"))  # of two texts in one file the greater digest counts
    made.unionByName(again).coalesce(1).write.parquet(g.source)
    (batch,) = g.run()
    ids = {i for i in range(n) if i % 1000 != 7}
    assert batch["documents"] == len(ids) and batch["without_id"] == n - len(ids)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert g.live() == postings({i: max(f"w{i % 5}", "x", key=digest) if i % 3 == 0 else f"w{i % 5}" for i in ids})

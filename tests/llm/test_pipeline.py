import os
import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import quality, words

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    if not os.path.isdir(FOLDER):
        pytest.skip("no sample tables")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [("documents", docs)]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        at = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, out[-1][1], FOLDER).write.parquet(at)
        out.append((name, spark.read.parquet(at)))
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in stages[1:]] == ["quality", "near_duplicates", "pii", "mixing", "bpe"]
    for _, df in stages[1:-1]:
        assert df.columns == stages[0][1].columns and dict(df.dtypes) == dict(stages[0][1].dtypes)


def test_each_stage_decides(stages, spark):
    rows = {n: [r.asDict() for r in df.collect()] for n, df in stages}
    net = quality.train(stages[0][1], spark.read.parquet(f"{FOLDER}/labels.parquet"))
    scores = net.score([r["text"].encode() for r in rows["documents"]])
    assert {r["doc_id"] for r in rows["quality"]} == {r["doc_id"] for r, s in zip(rows["documents"], scores) if s >= quality.THRESHOLD}
    texts = [r["text"] for r in rows["near_duplicates"]]
    assert len(set(texts)) == len(texts) and set(texts) <= {r["text"] for r in rows["quality"]}
    assert {r["text"] for r in rows["near_duplicates"]} and len(rows["pii"]) == len(texts)
    from lodestone.llm.pii import base_spans

    assert not any(base_spans(r["text"]) for r in rows["pii"])
    before = {r["doc_id"]: r["text"] for r in rows["near_duplicates"]}
    assert all(r["text"] == before[r["doc_id"]] for r in rows["pii"] if not base_spans(before[r["doc_id"]]) and "[TERM]" not in r["text"])
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert sum(count(r["text"]) for r in rows["mixing"]) == pytest.approx(sum(count(r["text"]) for r in rows["pii"]), abs=40)
    assert all(r["n_chars"] == len(r["text"]) for r in rows["mixing"])
    library = Tokenizer.from_file(words.default_vocabulary())
    want = sorted((r["doc_id"], library.encode(r["text"], add_special_tokens=False).ids) for r in rows["mixing"])
    assert sorted((r["doc_id"], list(r["ids"])) for r in rows["bpe"]) == want


def test_run_equals_its_stages(stages, spark):
    got = corpus_pipeline.run(spark, FOLDER)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got.collect()) == sorted((r["doc_id"], r["n_tokens"]) for r in stages[-1][1].collect())


@pytest.mark.parametrize("number", range(5))
def test_stages_take_awkward_tables(number, awkward, clashing, empty, spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, an empty table, and extra columns named as the stages' own."""
    if not os.path.isdir(FOLDER):
        pytest.skip("no sample tables")
    extra = clashing.withColumn("documents", clashing["n_chars"])
    results = []
    for docs in (awkward, extra, empty):
        stage = corpus_pipeline.STAGES[number][1]
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(len(results))))
        got = spark.read.parquet(str(tmp_path / str(len(results))))
        results.append(got)
        if number < 4:
            assert got.columns == docs.columns and dict(got.dtypes) == dict(docs.dtypes)
        else:
            assert got.columns == ["doc_id", "ids", "n_tokens"]
    plain, wide, none = results
    assert none.count() == 0
    assert sorted(map(str, wide.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    if number < 4:
        assert wide.filter("bucket is null or bucket <> 'clash' or score <> 'clash' or target <> 'clash'").count() == 0
    rows = [r["text"] for r in plain.collect()] if number < 4 else []
    if number == 1:
        assert sum(not t for t in rows) == 1 and rows.count("one") == 1
    if number == 2:
        assert len(rows) == awkward.count() and sum(t is None for t in rows) == 2
    if number == 3:
        assert rows and all(t and t.strip() for t in rows)
    if number == 4:
        assert plain.count() == awkward.count()

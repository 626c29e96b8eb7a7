import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import mixing


@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_targets(sizes):
    weights = [1 + i % 3 for i in range(len(sizes))]
    got = mixing.targets(sizes, weights, sum(sizes), 3)
    assert sum(got) == pytest.approx(sum(sizes)) and all(g <= 3 * n + 1e-6 for g, n in zip(got, sizes))
    free = [g / w for g, w, n in zip(got, weights, sizes) if g < 3 * n - 1e-6]
    if free:
        assert max(free) == pytest.approx(min(free)) and all(g / w <= free[0] + 1e-6 for g, w in zip(got, weights))


@given(st.integers(1, 5000), st.integers(0, 1 << 40))
@settings(max_examples=40, deadline=None)
def test_permutation(n, key):
    assert sorted(mixing.permute(np.arange(n), n, key).tolist()) == list(range(n))


def test_tree_splits_exact_quotas():
    tree = mixing.Tree([500, 0, 77, 1], 13, 5)
    leaves = np.array([tree.leaf(s) for s in range(13)])
    assert leaves.sum(axis=0).tolist() == [500, 0, 77, 1]
    assert np.ptp(leaves.sum(axis=1)) <= 1
    source = np.repeat(np.arange(4), [500, 0, 77, 1])
    place = np.concatenate([np.arange(n) for n in (500, 0, 77, 1)])
    shard = mixing.Tree([500, 0, 77, 1], 13, 5).shard_of(source, place)
    for s in range(13):
        assert np.bincount(source[shard == s], minlength=4).tolist() == leaves[s].tolist()


def test_tree_draws_are_hypergeometric():
    """The mean and the spread of one source's share of the first shard, over many seeds."""
    got = np.array([mixing.Tree([60, 40], 4, seed).leaf(0)[0] for seed in range(2000)])
    assert got.mean() == pytest.approx(25 * 0.6, abs=0.2)
    assert got.var() == pytest.approx(25 * 0.6 * 0.4 * 75 / 99, rel=0.12)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix_against_brute_force(spark, docs_schema):
    rows = [(i, " ".join(["w"] * (i * 37 % 91)), "en", f"s{i % 5}" if i % 7 else None, 0) for i in range(300)]
    docs = spark.createDataFrame(rows, docs_schema)
    got = mixing.mix(docs, block_words=16, shards=7).collect()
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + words(r[1])
    names = sorted(s for s in size if s) + [None]
    want = dict(zip(names, mixing.targets([size[s] for s in names], [1 + i % 3 for i in range(6)], sum(size.values()), 3)))
    taken = {}
    seen = set()
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and r["taken"] <= 3 * r["size"]
        assert r["taken"] == sum(x["n_words"] for x in r["slices"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        for x in r["slices"]:
            span = {(r["doc_id"], x["epoch"], w) for w in range(x["first_word"], x["first_word"] + x["n_words"])}
            assert not span & seen and x["first_word"] + x["n_words"] <= r["size"]
            seen |= span
    for s in names:
        assert taken[s] == pytest.approx(want[s], abs=1)
    again = mixing.mix(docs.repartition(5), block_words=16, shards=7)
    assert {(r["doc_id"], str(r["slices"])) for r in got} == {(r["doc_id"], str(r["slices"])) for r in again.collect()}


def test_texts_and_shards(spark, docs_schema):
    docs = spark.createDataFrame([(i, f" {i}a  {i}b\n{i}c ", "en", f"s{i % 3}", 9) for i in range(60)], docs_schema)
    mixed = mixing.mix(docs, block_words=4, shards=3, carry=["text", "lang", "n_chars"])
    texts = mixing.mixed_texts(mixed)
    assert texts.columns == ["doc_id", "source", "text", "lang", "n_chars"]
    assert sum(words(r["text"]) for r in texts.collect()) == sum(r["taken"] for r in mixed.collect())
    dealt = mixing.dealt(mixing.mix(docs, block_words=4, shards=3)).collect()
    assert {r["shard"] for r in dealt} == {0, 1, 2}


def test_awkward_rows(awkward, clashing, empty):
    got = mixing.mix(awkward).collect()
    assert len(got) == awkward.count()
    assert all(r["size"] == 0 and r["taken"] == 0 for r in got if r["doc_id"] in (2, 3, 4))
    assert sorted(map(str, mixing.mix(clashing).collect())) == sorted(map(str, got))
    assert mixing.mix(empty).count() == 0


def test_a_cluster_must_name_the_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from lodestone.llm import common

    def session(master):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda at: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            common.scratch(session(master))
    named = session("yarn")
    named.conf.get = lambda *_: "hdfs:///shared/"
    assert common.scratch(named) == "hdfs:///shared"

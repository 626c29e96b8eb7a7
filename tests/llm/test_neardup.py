import itertools
import random

import numpy as np
import pytest

from lodestone.llm import neardup, shingles


def plain_sets(text, words=5):
    import re

    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
    return [tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []


def corpus(seed=0, groups=25):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([8, 60, 150]))]
        for edits in (0, 0, 1, 2, 4, 9):
            t = list(base)
            for _ in range(edits):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
    return texts + [" ".join(word() for _ in range(60)) for _ in range(80)] + ["", "  ", None, "...", "one two", "One  TWO!"]


def bags(texts):
    """Weighted multisets of shingles, in plain Python, from exact document frequencies."""
    from collections import Counter
    from math import log, sqrt

    counts = [Counter(plain_sets(t or "")) for t in texts]
    df, n = Counter(s for c in counts for s in c), len(texts)
    noise = sum(df.values()) / (1 << neardup.BIN_BITS)
    lift = {s: 1 + neardup.LIFT * min(1, max(0, log(n / max(1, min(n, d - noise - 4 * sqrt(noise)))) / log(n + 2))) for s, d in df.items()}
    return [{s: k * lift[s] for s, k in c.items()} for c in counts]


def partition(texts, bag, least):
    """Components of all pairs, by brute force over the pairs that share a shingle."""
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(texts)), 2):
        same = (texts[a] or "") == (texts[b] or "")
        if not same and bag[a] and bag[b]:
            shared = sum(min(w, bag[b][s]) for s, w in bag[a].items() if s in bag[b])
            same = shared >= least * (sum(bag[a].values()) + sum(bag[b].values()) - shared)
        if same:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def agrees(got, texts):
    """Every pair of similarity 0.81 is in one class; all of a class hangs together by pairs of 0.79: bins round weights."""
    bag = bags(texts)
    sure, likely = partition(texts, bag, 0.81), partition(texts, bag, 0.79)
    assert all(got[i] == got[r] for i, r in enumerate(sure))
    assert all(likely[i] == likely[c] for i, c in enumerate(got))


def table(spark, docs_schema, texts):
    return spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], docs_schema).repartition(5)


def test_classes_equal_brute_force(spark, docs_schema):
    texts = corpus()
    docs = table(spark, docs_schema, texts)
    got = {r["doc_id"]: r for r in neardup.classes(docs).collect()}
    agrees([got[i]["class_id"] for i in range(len(texts))], texts)
    sizes = np.unique([r["class_id"] for r in got.values()], return_counts=True)
    assert {r["class_id"]: r["class_size"] for r in got.values()} == dict(zip(*(x.tolist() for x in sizes)))
    assert sorted(i for i, r in got.items() if r["keep"]) == sorted({r["class_id"] for r in got.values()})
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in got.items() if r["keep"])


def graded(n, seed=4):
    """A large group of copies with 0 to 12 edits each, and texts that share a long passage only."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, passage = [word() for _ in range(90)], [word() for _ in range(60)]
    texts = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(13)):
            t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t))
    for _ in range(n // 4):
        own = [word() for _ in range(12)]
        texts += [" ".join(passage + own)] + [" ".join(own[:3] + passage + own)] * (rng.random() < 0.2)
    return texts


@pytest.mark.parametrize("block,many", [(1024, 16), (64, 16), (48, 0)])
def test_large_groups_lose_no_link(spark, docs_schema, monkeypatch, block, many):
    """500 graded copies and texts that share a passage: in one block, in pieces and blocks, and split by prefixes."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "MANY", many)
    texts = graded(500)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(table(spark, docs_schema, texts)).collect()}
    agrees([got[i] for i in range(len(texts))], texts)


@pytest.mark.parametrize("many", [1000, 0])
def test_open_buckets_are_compared_exactly(spark, monkeypatch, many):
    """One bucket of 90 nodes, several blocks a side: a large component and single nodes, whose only links lie far apart."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "MANY", many)
    rng = np.random.default_rng(3)
    kinds = [np.sort(rng.choice(1 << 40, 50, replace=False).astype(np.uint64)) for _ in range(60)]
    kind = [*range(60), *range(30)]  # node i and node i + 60 are equal, for i below 30
    sets = spark.createDataFrame([(i, bytearray(kinds[k].tobytes())) for i, k in enumerate(kind)], "node long, ids binary")
    comps = neardup.keep(spark.createDataFrame([(i, 50) for i in range(51, 60)], "node long, comp long"), "test")
    lift = spark.sparkContext.broadcast(np.ones(1 << neardup.BIN_BITS, np.float32))
    got = neardup.settle(spark.createDataFrame([(7, i, 50) for i in range(90)], "key long, node long, size long"), comps, sets, lift, 0.8)
    assert sorted(map(tuple, got.select("node", "comp").collect())) == [(i, 50) for i in range(51, 60)] + [(i + 60, i) for i in range(30)]


def test_similarities_of_a_block_equal_plain_ones(monkeypatch):
    rng = np.random.default_rng(5)
    lift = (1 + 0.25 * rng.random(1 << neardup.BIN_BITS)).astype(np.float32)
    base = rng.choice(1 << neardup.ID_BITS, 60, replace=False).astype(np.uint64)
    sets = [np.sort(np.concatenate([rng.choice(base, rng.integers(40, 60), replace=False), rng.choice(base[:9], rng.integers(0, 30))])) for _ in range(40)] + [np.sort(rng.choice(1 << 40, 5).astype(np.uint64)) for _ in range(3)]
    for rare, columns in ((12, 2048), (0, 7), (100, 7)):
        monkeypatch.setattr(neardup, "RARE", rare)
        monkeypatch.setattr(neardup, "COLUMNS", columns)
        for least in (0.5, 0.6, 0.7):
            got = neardup.similar(sets, lift, least)
            assert all(got[a, b] == (neardup.similarity(sets[a], sets[b], lift) >= least) for a, b in itertools.permutations(range(len(sets)), 2))


def test_consistent_samples_estimate_similarity():
    rng = np.random.default_rng(0)
    ids = np.sort(rng.choice(1 << neardup.ID_BITS, 3000, replace=False).astype(np.uint64))
    a, b = ids[:2200], ids[300:]
    w = (1 + rng.random(3000) * 3).astype(np.float32)
    wb = w.copy()
    wb[:1500] *= 1.2
    least = np.minimum(w[300:2200], wb[300:2200]).sum()
    true = least / (w[:2200].sum() + wb[300:].sum() - least)
    same = []
    for shift in range(12):  # fresh ids give fresh samples
        move = np.uint64(shift * 7919)
        order = lambda x: (x ^ move) & np.uint64((1 << neardup.ID_BITS) - 1)
        s = neardup.samples(np.concatenate([order(a), order(b)]), np.concatenate([w[:2200], wb[300:]]), np.array([len(a), len(b)]))
        same.append((s[0] == s[1]).mean())
    assert np.mean(same) == pytest.approx(true, abs=0.05)


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)]
    links = [(min(a, b), max(a, b)) for a, b in links if a != b]
    label = {x: x for p in links for x in p}
    for _ in range(100):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = dict(map(tuple, neardup.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == label
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_awkward_rows(awkward, clashing, empty):
    for docs in (awkward, clashing):
        got = neardup.classes(docs).collect()
        assert len(got) == awkward.count() and sum(r["keep"] for r in got) == len({r["tk"] for r in got})
    assert neardup.classes(empty).count() == 0
    assert neardup.one_of_each(clashing).columns == clashing.columns


def test_shingles_match_a_plain_count():
    texts = ["a b c d e f a b c d e", "é É ü x", "", "one"]
    ids, counts, sizes = shingles.shingle_sets(texts)
    assert sizes.tolist() == [len(set(plain_sets(t))) for t in texts] and counts.sum() == sum(len(plain_sets(t)) for t in texts)

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import queries, runs


def naive(word, least=12):
    """Every period in turn: stretches of equal words a period apart, without those that a smaller period has."""
    found, n = {}, len(word)
    for q in range(1, n // 2 + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and word[end] == word[end + q]:
                end += 1
            if end - at >= q:
                found.setdefault((at, end + q), q)
            at = end + 1
    return sorted((a, b - a, q) for (a, b), q in found.items() if b - a >= max(least, 2 * q))


@given(st.lists(st.integers(0, 2), max_size=70), st.integers(1, 9), st.integers(2, 5))
@settings(max_examples=300, deadline=None)
def test_runs_equal_the_naive_ones(word, period, times):
    word = word + word[:period] * times + [9] + word
    for least in (4, 12):
        assert runs.word_runs(np.array(word, np.int64), least) == naive(word, least)


def test_words_of_many_runs():
    a, b = [0], [0, 1]
    while len(b) < 400:  # the word with the most repetitions inside repetitions
        a, b = b, b + a
    assert runs.word_runs(np.array(b)) == naive(b)
    for seed in range(8):
        rng = random.Random(seed)
        w = []
        while len(w) < 500:
            w += [rng.randrange(4) for _ in range(rng.randrange(9))] * rng.randrange(1, 7)
        assert runs.word_runs(np.array(w)) == naive(w)


def test_long_stretches_take_little():
    assert runs.word_runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    w = np.tile(np.arange(50_000), 4)
    assert runs.word_runs(w) == [(0, 200_000, 50_000)]


def test_automaton_has_every_part_and_few_states():
    w = [0, 1, 0, 0, 1, 0, 1, 1, 0]
    made = runs.Automaton(w)
    assert len(made.length) <= 2 * len(w)
    parts = {tuple(w[i:j]) for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    assert sum(made.length[s] - made.length[made.link[s]] for s in range(1, len(made.length))) == len(parts)
    for p in parts:
        s = 0
        for c in p:
            s = made._after(s, c)
            assert s >= 0


def test_ends_stay_in_order():
    rng = random.Random(1)
    every = list(range(5000))
    rng.shuffle(every)
    ends, seen = runs.Ends(every[0]), [every[0]]
    for e in every[1:]:
        got = ends.add(e)
        if len(seen) < 300:
            assert got == (max([x for x in seen if x < e], default=-1), min([x for x in seen if x > e], default=-1))
        seen.append(e)
    assert list(ends) == sorted(every) and ends.size == 5000


@given(st.lists(st.lists(st.integers(0, 1), max_size=40), max_size=5))
@settings(max_examples=100, deadline=None)
def test_words_put_aside_are_in_no_run(texts):
    word = np.array([w for t in texts for w in t], np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    in_play = runs.repeated(word, owner, 6)
    for i, t in enumerate(texts):
        mine = in_play[owner == i]
        for s, n, _ in naive(t):
            assert mine[s : s + n].all()


def expected(text, doc_id=None, planted=False):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if planted and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = naive(words)
    drop = {i for s, k, q in found for i in range(s + q, s + k)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{k},{q}\n" for s, k, q in sorted(found, key=lambda r: (r[0], r[2])))
    left = " ".join(w for i, w in enumerate(words) if i not in drop)
    numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *numbers, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest()), found, left


def some_texts():
    rng = random.Random(5)
    out = ["", " ", "one", "ab\x0bcd\x1cef gh \x85 x"]
    for i in range(60):
        words = [rng.choice("der die das the el la ß é 1 . ,, -".split()) for _ in range(rng.randrange(120))]
        if i % 3 == 0:
            words[5:5] = words[:7] * rng.randrange(2, 6)
        out.append(rng.choice([" ", "\n", " \t"]).join(words))
    return out


def test_texts_in_groups_and_alone():
    texts = some_texts()
    for some in (texts, *[[t] for t in texts]):
        got = runs.texts_with_runs(some, [None] * len(some))
        for t, g in zip(some, got):
            _, found, left = expected(t)
            assert g.runs == found and str(g.collapsed, "utf-8") == left


def test_query_digests_with_planted_repetitions(spark, docs_schema):
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(some_texts() * 8)]
    docs = spark.createDataFrame(rows, docs_schema)
    got = {r["doc_id"]: tuple(r) for r in runs.digests(docs, order=queries.planted_order).collect()}
    want = {i: expected(t, i, planted=True)[0] for i, t, *_ in rows}
    assert got == want and sum(w[1] > 0 for w in want.values()) > 50


def test_awkward_tables(awkward, clashing, empty):
    want = sorted(str((r["doc_id"], *expected(r["text"])[0][1:])) for r in awkward.filter("doc_id <> 5 or doc_id is null").collect())
    for docs in (awkward, clashing):
        assert sorted(str(tuple(r)) for r in runs.digests(docs.filter("doc_id <> 5 or doc_id is null")).collect()) == want
    numbers = F.expr("array_join(transform(sequence(1, 120000), i -> concat('w', i)), ' ')")
    long = runs.runs(awkward.filter("doc_id = 5").withColumn("text", F.repeat(F.concat(numbers, F.lit(" ")), 3))).first()
    assert [tuple(r) for r in long["runs"]] == [(0, 360_000, 120_000)] and len(long["text"].split()) == 120_000
    assert runs.digests(empty).count() == 0 and runs.runs(empty).count() == 0
    full = {r["doc_id"]: r for r in runs.runs(awkward.filter("doc_id in (3, 7)")).collect()}
    assert full[3]["runs"] == [] and full[3]["text"] == "" and full[7]["text"] == "one"

import zlib

import numpy as np
import pytest

from lodestone.llm import quality


def texts(n, seed=0):
    rng = np.random.default_rng(seed)
    parts = "the of and er th ing on an re in".split()
    out, labels = [], []
    for i in range(n):
        ws = ["".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(rng.integers(20, 90))]
        good = i % 3 > 0
        out.append((" ".join(ws) if good else "!! ".join(w.upper() for w in ws)).encode())
        labels.append(int(good))
    return out, np.array(labels)


def test_gradients_are_those_of_the_loss(monkeypatch):
    net = quality.Net(3)
    rng = np.random.default_rng(1)
    x, y = [bytes(rng.integers(97, 110, n).tolist()) for n in (30, 700, 0)], np.array([1.0, 0.0, 1.0], np.float32)
    w = np.ones(3, np.float32)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    grads, _ = net.gradients(x, y, w)

    def loss():
        net.tables = None
        p = net.score(x)
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean()

    for k in ("out", "out_bias", "hidden", "hidden_bias", "bias", "filter"):
        flat, g = net.p[k].ravel(), grads[k].ravel()
        for i in np.argsort(-np.abs(g))[:3]:
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert (up - down) / 2e-5 == pytest.approx(g[i], rel=0.02, abs=1e-5), k


def test_learns_and_scores_alike_in_any_batch():
    x, y = texts(240)
    net = quality.fit(x[:160], y[:160], epochs=3)
    got = net.score(x)
    assert ((got >= quality.THRESHOLD) == y)[160:].mean() >= 0.95
    assert np.allclose(got, np.concatenate([net.score(x[i : i + 7]) for i in range(0, 240, 7)]), atol=1e-6)
    edge = [b"a" * n for n in range(500, 520)] + [b"b" * quality.SPAN + b"c" * n for n in (0, 1, 255, 256, 300)]
    assert np.allclose(net.score(edge), np.concatenate([net.score([t]) for t in edge]), atol=1e-6)
    again = quality.fit(x[:160], y[:160], epochs=3)
    assert (again.score(x) == got).all()


def test_long_text_is_read_whole():
    x, y = texts(240)
    net = quality.fit(x[:160], y[:160], epochs=3)
    good, bad = b" ".join(t for t, k in zip(x, y) if k), b" ".join(t for t, k in zip(x, y) if not k)
    filler = b" ".join([good] * (quality.SPAN // len(good) + 2))
    assert len(filler) > quality.SPAN
    assert net.score([filler + bad * 3])[0] < net.score([filler])[0]


def test_one_class_or_no_rows():
    assert quality.fit([], np.zeros(0, int)).score([b"x"])[0] > 0.9
    assert quality.fit([b"x", b"y"], np.array([0, 0])).score([b"x"])[0] < 0.1


def test_table(spark, docs_schema, awkward, clashing, empty):
    x, y = texts(200)
    docs = spark.createDataFrame([(i, t.decode(), "en", "a", 0) for i, t in enumerate(x)], docs_schema)
    labels = spark.createDataFrame([(i, int(k), 0) for i, k in enumerate(y)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    net = quality.train(docs, labels)
    got = {r["doc_id"]: r for r in quality.classify(docs, net).collect()}
    for i in range(200):
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i]["predicted"] == int(got[i]["score"] >= 0.3)
    held = [i for i in got if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == y[i] for i in held]) >= 0.9
    rows, _ = quality.training_rows(docs, labels, "doc_id", "text", 2000, 60_000)
    assert set(rows) == {x[i] for i in range(200) if i not in held}
    plain = sorted(str(tuple(r)) for r in quality.classify(awkward, net).collect())
    assert len(plain) == awkward.count() and sorted(str(tuple(r)) for r in quality.classify(clashing, net).collect()) == plain
    assert quality.classify(empty, net).count() == 0


def test_scores_equal_a_naive_convolution():
    """Every filter at every second byte, the maximum of every chunk, the hidden layer, mean and maximum over chunks: said in loops."""
    rng = np.random.default_rng(5)
    net = quality.Net(3)
    for name in ("bias", "hidden_bias", "out_bias"):
        net.p[name] = rng.normal(0, 0.3, net.p[name].shape).astype(np.float32)
    sizes = [0, 1, 7, 8, 255, 256, 257, 511, 512, 513, 700, 1500]
    texts = [rng.integers(1, 256, n, dtype=np.uint8).tobytes() for n in sizes]
    p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def naive(text):
        halves = max(1, -(-len(text) // 256))
        read = text + bytes(256 * halves - len(text) + 8)
        best = []
        for start in range(0, max(1, halves - 1) * 256, 256):  # chunks of 512 bytes, each 256 after the one before
            places = range(start, min(start + 512, 256 * halves), 2)
            pooled = np.max([sum(p["filter"][j, read[at + j]] for j in range(8)) for at in places], axis=0)
            best.append(np.maximum(np.maximum(pooled + p["bias"], 0) @ p["hidden"] + p["hidden_bias"], 0))
        z = np.concatenate([np.mean(best, axis=0), np.max(best, axis=0)]) @ p["out"] + p["out_bias"][0]
        return 1 / (1 + np.exp(-z))

    assert net.score(texts) == pytest.approx([naive(t) for t in texts], abs=1e-5)
    assert net.score(texts[::-1])[::-1] == pytest.approx(net.score(texts), abs=1e-6)

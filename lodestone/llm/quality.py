"""Quality classifier: a byte-level convolutional network in numpy.

Filters of WIDTH bytes run over the whole text at every second byte. Their responses are max-pooled over chunks of
2 * HALF bytes that overlap by half and cover the document. A hidden layer reads each chunk's pooled responses;
its units' means and maxima over all chunks are combined by a logistic unit into one probability. Training follows
the gradients through the pooled positions alone. For scoring, a filter's weights for pairs of bytes are tabulated.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

WIDTH, STRIDE, FILTERS, HALF, HIDDEN = 8, 2, 32, 256, 24
#: Labelled rows of each class that training looks at, and the longest text (in characters) among them.
SAMPLE_PER_CLASS, SAMPLE_CHARS = 2000, 60_000
EPOCHS, BATCH, RATE = 14, 32, 0.004
#: Steps at least, however few rows there are; and the share of good texts cut to a few words in each step, because
#: short texts are rare and look poor to pooled filters.
STEPS, SHORTENED = 1200, 0.12
THRESHOLD = 0.3
#: Bytes of texts that are scored at once.
SPAN = 1 << 18


def pieces(text: bytes) -> int:
    """Half chunks of a text; an empty text has one."""
    return max(1, -(-len(text) // HALF))


class Net:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.p = {
            "filter": rng.normal(0, 0.25, (WIDTH, 256, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "hidden": rng.normal(0, (2 / FILTERS) ** 0.5, (FILTERS, HIDDEN)).astype(np.float32),
            "hidden_bias": np.zeros(HIDDEN, np.float32),
            "out": rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32),
            "out_bias": np.zeros(1, np.float32),
        }
        self.tables = None

    def tabulate(self) -> None:
        f = self.p["filter"]
        self.tables = [(f[j][:, None, :] + f[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)]

    def responses(self, texts: list[bytes]):
        """Responses of all filters per half chunk (halves, places, FILTERS), the padded bytes, and halves per text."""
        counts = [pieces(t) for t in texts]
        room = [c * HALF for c in counts]
        flat = np.zeros(sum(room) + WIDTH, np.uint8)
        at = 0
        for t, r in zip(texts, room):
            flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
            at += r
        pair = flat[:-1].astype(np.int32) * 256 + flat[1:]
        n = sum(room) // STRIDE
        out = self.tables[0][pair[0 : 2 * n : 2]]
        for j in range(1, WIDTH // 2):
            out += self.tables[j][pair[2 * j : 2 * j + 2 * n : 2]]
        out = out.reshape(-1, HALF // STRIDE, FILTERS)
        ends = np.cumsum(counts)  # a text's last filters see zeros behind it, not the next text
        for place in range((HALF - WIDTH) // STRIDE + 1, HALF // STRIDE):
            at = (ends - 1) * HALF + STRIDE * place
            out[ends - 1, place] = sum(self.tables[j][pair[at + 2 * j] if STRIDE * place + 2 * j < HALF else 0] for j in range(WIDTH // 2))
        return out, flat, np.array(counts)

    def upper(self, pooled: np.ndarray, counts: np.ndarray):
        """From pooled half chunks to logits; what the gradients need comes along."""
        p = self.p
        starts = np.cumsum(counts) - counts
        last = np.zeros(len(pooled), bool)
        last[starts + counts - 1] = True
        after = np.where(last, np.arange(len(pooled)), np.arange(len(pooled)) + 1)
        take_next = pooled[after] > pooled
        chunk = np.maximum(pooled, pooled[after])
        keep = ~last
        keep[starts[counts == 1]] = True  # n halves make n - 1 chunks, a single half makes one
        rows = np.flatnonzero(keep)
        owner = np.repeat(np.arange(len(counts)), counts)[rows]
        x = np.maximum(chunk[rows] + p["bias"], 0)
        h = np.maximum(x @ p["hidden"] + p["hidden_bias"], 0)
        n = np.maximum(counts - 1, 1)
        first = np.cumsum(n) - n
        mean = np.add.reduceat(h, first, axis=0) / n[:, None]
        top = np.maximum.reduceat(h, first, axis=0)
        z = np.concatenate([mean, top], axis=1)
        return z @ p["out"] + p["out_bias"][0], (rows, owner, after, take_next, x, h, n, top, z)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities of label 1; a text of any length is pooled in spans of bounded size."""
        if self.tables is None:
            self.tabulate()
        pooled, counts = [], []
        run: list[bytes] = []
        held = 0

        def flush():
            nonlocal run, held
            if run:
                r, _, _ = self.responses(run)
                pooled.append(r.max(axis=1))
                run, held = [], 0

        for t in texts:
            counts.append(pieces(t))
            if len(t) > SPAN:  # spans end at half chunks and come with the bytes that their last filters see
                flush()
                for a in range(0, len(t), SPAN):
                    r, _, _ = self.responses([t[a : a + SPAN + WIDTH - 1]])
                    pooled.append(r.max(axis=1)[: SPAN // HALF if a + SPAN < len(t) else None])
                continue
            if held + len(t) > SPAN:
                flush()
            run.append(t)
            held += len(t) + HALF
        flush()
        if not counts:
            return np.zeros(0)
        logit, _ = self.upper(np.concatenate(pooled), np.array(counts))
        return 1 / (1 + np.exp(-logit.astype(np.float64)))

    def gradients(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray):
        self.tabulate()
        r, flat, counts = self.responses(texts)
        where = r.argmax(axis=1)
        pooled = np.take_along_axis(r, where[:, None, :], 1)[:, 0]
        logit, (rows, owner, after, take_next, x, h, n, top, z) = self.upper(pooled, counts)
        prob = 1 / (1 + np.exp(-logit))
        g = ((prob - y) * weight / len(y)).astype(np.float32)
        out = {"out": z.T @ g, "out_bias": np.array([g.sum()], np.float32)}
        gz = g[:, None] * self.p["out"][None]
        gh = gz[:, :HIDDEN][owner] / n[owner][:, None]
        hit = h == top[owner]
        gh += np.where(hit, gz[:, HIDDEN:][owner], 0)
        gh *= h > 0
        out["hidden"], out["hidden_bias"] = x.T @ gh, gh.sum(axis=0)
        gx = (gh @ self.p["hidden"].T) * (x > 0)
        out["bias"] = gx.sum(axis=0)
        half = np.where(take_next[rows], after[rows][:, None], rows[:, None])  # the half chunk that won
        unit = np.broadcast_to(np.arange(FILTERS), half.shape)
        live = gx != 0
        half, unit, gx = half[live], unit[live], gx[live]
        at = half * HALF + where[half, unit] * STRIDE
        size = WIDTH * 256 * FILTERS
        total = np.zeros(size)
        final = np.zeros(len(r), bool)
        final[np.cumsum(counts) - 1] = True
        final = final[half]
        for j in range(WIDTH):
            byte = np.where(final & (at % HALF + j >= HALF), 0, flat[at + j])
            total += np.bincount((j * 256 + byte.astype(np.int64)) * FILTERS + unit, gx, size)
        out["filter"] = total.reshape(WIDTH, 256, FILTERS).astype(np.float32)
        return out, float((weight * -(y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))).mean())


def shortened(text: bytes, rng) -> bytes:
    """A stretch of 3 to 30 words."""
    words = text.split(b" ")
    n = int(rng.integers(3, 31))
    a = int(rng.integers(0, max(1, len(words) - n)))
    return b" ".join(words[a : a + n])


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> Net:
    """Adam over shuffled batches; both classes weigh the same."""
    net, rng = Net(seed), np.random.default_rng(seed)
    y = labels.astype(np.float32)
    if not len(texts) or y.min() == y.max():
        net.p["out"][:] = 0
        net.p["out_bias"][:] = 4.0 if not len(texts) or y.min() == 1 else -4.0
        return net
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    m, v, t = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0
    epochs = max(epochs, -(-STEPS * BATCH // len(texts)))
    steps = epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            grads, _ = net.gradients([shortened(texts[i], rng) if y[i] == 1 and rng.random() < SHORTENED else texts[i] for i in pick], y[pick], weight[pick])
            t += 1
            rate = RATE * min(1.0, t / 50) * (1 - t / (steps + 1)) ** 0.5
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.p[k] = net.p[k] - (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    net.tables = None
    return net


def held_out(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, per_class: int, chars: int):
    """A bounded sample of rows that are not held out: per class those with the smallest id hashes."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_y")).filter("_id is not null and _y in (0, 1)").filter(~held_out("_id"))
    picks = [known.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    ids = picks[0].unionByName(picks[1])
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).filter(F.length("_t") <= chars)
    got = rows.join(F.broadcast(ids), "_id").orderBy(F.xxhash64("_id"), "_id", "_y", F.crc32("_t")).limit(4 * per_class).toArrow()
    return [t.encode("utf-8") for t in got.column("_t").to_pylist()], np.array(got.column("_y").to_pylist(), np.int64)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = SAMPLE_PER_CLASS, chars: int = SAMPLE_CHARS) -> Net:
    return fit(*training_rows(docs, labels, id_col, text_col, per_class, chars))


def accepted(docs: DataFrame, net: Net, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns as they are.

    Defined cases: as of ``classify``; a null text is scored as an empty one and stays null; repeated rows are judged alike.
    """
    spark = docs.sparkSession
    small_batches(spark)
    blob = spark.sparkContext.broadcast(pickle.dumps(net.p))
    at = docs.columns.index(text_col)

    def run(batches):
        net = Net()
        net.p = pickle.loads(blob.value)
        for batch in batches:
            score = net.score([(t or "").encode("utf-8") for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(np.asarray(score, np.float64) >= THRESHOLD))

    return docs.mapInArrow(tidy(run), docs.schema)


def classify(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text", keep_cols=()) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted and the ``keep_cols``.

    Defined cases: null and empty texts get the score of a chunk of zeros; long texts are read whole, in spans; a null
    doc_id is held out as null; equal texts get equal scores; an empty table gives an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    blob = spark.sparkContext.broadcast(pickle.dumps(net.p))
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("_text"), *[F.col(c).alias(f"_keep_{c}") for c in keep_cols])
    names = ["doc_id", "held_out", *[f"_keep_{c}" for c in keep_cols]]
    schema = rows.select(*names).schema.add("score", "double")

    def run(batches):
        net = Net()
        net.p = pickle.loads(blob.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(net.score(batch.column("_text").to_pylist()), pa.float64())], names=[*names, "score"])

    out = rows.mapInArrow(tidy(run), schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    return out.withColumnsRenamed({f"_keep_{c}": c for c in keep_cols})

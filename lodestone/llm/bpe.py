"""BPE encoding and decoding with a transducer lexicon of frequent words.

Words are counted over the whole corpus; the most frequent ones are merged once, on the driver, and compiled
into a minimal acyclic transducer, which every worker memory-maps. A word that the lexicon has not seen is
merged exactly, by the vocabulary's merge ranks.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, remembered, small_batches, tidy
from .lexicon import Lexicon, build
from .words import SPECIAL, WORD_END, Splitter, byte_letters, default_vocabulary, spread, stretches

#: Words of the lexicon, the most frequent of the corpus, and their longest in bytes: bounds on what is collected and sent
#: to executors. Longer words are merged like other unseen ones.
LEXICON_WORDS, LEXICON_BYTES = 1 << 17, 64
#: Distinct words that a task counts before it passes their counts on.
COUNTED = 250_000
#: Words of up to so many bytes are merged together, longer ones one by one.
TOGETHER = 64


class Merger:
    """Exact merging of words by the vocabulary's ranks."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))
        vocab: dict[str, int] = model["model"]["vocab"]
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["model"]["merges"]]
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.uint32)
        self.last = np.array([vocab[c + WORD_END] for c in letters], np.uint32)
        self.into = np.array([vocab[a + b] for a, b in pairs], np.uint32)
        key = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.uint64)
        by = np.argsort(key, kind="stable")
        by = by[np.append(key[by][1:] != key[by][:-1], True)] if len(by) else by  # of a pair given twice the last counts
        self.key, self.rank_of = key[by], by.astype(np.int32)
        self.none = np.int32(len(pairs))
        self.tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in model["added_tokens"]}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, ``none`` for those that don't merge."""
        if not len(self.key):
            return np.full(len(a), self.none)
        key = (a.astype(np.uint64) << np.uint64(32)) | b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank_of[at], self.none)

    def ids(self, flat: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, flat, and how many each has; words are runs of ``flat``, one after the other, ``length`` bytes each."""
        ends = np.cumsum(length)
        part = self.first[flat]
        some = length > 0
        part[ends[some] - 1] = self.last[flat[ends[some] - 1]]
        long = np.flatnonzero(length > TOGETHER)
        if len(long):
            lists: list = [None] * len(length)
            for i in long.tolist():
                lists[i] = self.merged_alone(part[ends[i] - length[i] : ends[i]])
            short = np.flatnonzero(length <= TOGETHER)
            ids, count = self.merged(part[spread((ends - length)[short], length[short])], length[short])
            at = np.cumsum(count) - count
            for i, a, n in zip(short.tolist(), at.tolist(), count.tolist()):
                lists[i] = ids[a : a + n]
            return np.concatenate(lists), np.fromiter(map(len, lists), np.int64, len(lists))
        return self.merged(part, length)

    def merged(self, part: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All words merge at once, in every turn the leftmost pair of least rank of each word that has one."""
        own = np.flatnonzero(length > 0)
        size = length[own].astype(np.int64)
        rank = np.full(len(part), self.none)
        if len(part) > 1:
            rank[:-1] = self.ranks(part[:-1], part[1:])
        rank[np.cumsum(size) - 1] = self.none
        done_own, done_size, done_part = [], [], []
        while len(own):
            start = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, start)
            ended = least == self.none
            if ended.any():
                inside = np.repeat(ended, size)
                done_own.append(own[ended])
                done_size.append(size[ended])
                done_part.append(part[inside])
                own, size, part, rank, least = own[~ended], size[~ended], part[~inside], rank[~inside], least[~ended]
                if not len(own):
                    break
                start = np.cumsum(size) - size
            at = np.flatnonzero(rank == np.repeat(least, size))
            at = at[np.searchsorted(at, start)]
            part[at] = self.into[least]
            kept = np.ones(len(part), bool)
            kept[at + 1] = False
            part, rank = part[kept], rank[kept]
            at -= np.arange(len(at))  # one part less in each word before
            size = size - 1
            ends = np.cumsum(size)
            inner = at + 1 < ends
            rank[at] = self.none
            rank[at[inner]] = self.ranks(part[at[inner]], part[at[inner] + 1])
            inner = at > ends - size
            rank[at[inner] - 1] = self.ranks(part[at[inner] - 1], part[at[inner]])
        count = np.zeros(len(length), np.int64)
        if not done_own:
            return np.zeros(0, np.uint32), count
        own, size, part = np.concatenate(done_own), np.concatenate(done_size), np.concatenate(done_part)
        count[own] = size
        by = np.argsort(own)
        return part[spread((np.cumsum(size) - size)[by], size[by])], count

    def merged_alone(self, part: np.ndarray) -> np.ndarray:
        """One word of any length, by a heap over a linked list."""
        parts, into, none = part.tolist(), self.into.tolist(), int(self.none)
        n = len(parts)
        after, before, alive = list(range(1, n)) + [-1], [-1, *range(n - 1)], [True] * n
        ranks = self.ranks(part[:-1], part[1:])
        known: dict[tuple[int, int], int] = {}

        def rank(a: int, b: int) -> int:
            if (a, b) not in known:
                known[a, b] = int(self.ranks(np.array([a], np.uint32), np.array([b], np.uint32))[0])
            return known[a, b]

        heap = [(int(ranks[i]), i, parts[i], parts[i + 1]) for i in np.flatnonzero(ranks < none).tolist()]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = into[r], False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := rank(parts[x], parts[y])) < none:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return np.array([p for p, ok in zip(parts, alive) if ok], np.uint32)


def flat_bytes(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words, and where each begins; the last entry is the end."""
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


class Written:
    """A stretch's words: which text each belongs to, and their ids in turn."""

    def __init__(self, run, per_text, number, start, count, ids):
        self.texts = [i for i, _ in run]
        self.ends = np.concatenate([[0], np.cumsum(per_text)])
        self.number, self.start, self.count, self.ids = number, start, count, ids

    def id_arrays(self):
        """(text number, ids) of every text of the stretch."""
        flat = self.ids[spread(self.start[self.number], self.count[self.number])]
        ends = np.concatenate([[0], np.cumsum(self.count[self.number])])[self.ends].tolist()
        return ((i, flat[a:b]) for i, a, b in zip(self.texts, ends, ends[1:]))

    def joined(self, names: pa.StringArray):
        """(text number, bytes) of every text of the stretch: the names of its ids, one after the other."""
        spelt = names.take(pa.array(self.ids))
        _, at = flat_bytes(spelt)
        at = at[np.append(self.start, len(self.ids))]
        words = pa.StringArray.from_buffers(len(self.start), pa.py_buffer(np.ascontiguousarray(at)), spelt.buffers()[2])
        data, at = flat_bytes(words.take(pa.array(self.number)))
        data, at = memoryview(data), at[self.ends].tolist()
        return ((i, data[a:b]) for i, a, b in zip(self.texts, at, at[1:]))


class Encoder:
    """Texts to ids in one worker: the distinct words of a stretch walk the lexicon together, unseen ones are merged together."""

    def __init__(self, path: str, lexicon: Lexicon):
        self.split, self.merger, self.lexicon = Splitter(path), Merger(path), lexicon
        tokens = self.merger.tokens
        every = range(max(tokens) + 1)
        self.numerals = pa.array([f"{i} " for i in every], pa.string())
        self.spellings = pa.array([tokens.get(i, "") + " " for i in every], pa.string())

    def look_up(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each word's ids begin, how many it has, and all ids, in the order of the words."""
        flat, offsets = flat_bytes(words)
        length = np.diff(offsets).astype(np.int64)
        special = np.flatnonzero((length > 1) & (flat[np.minimum(offsets[:-1], max(len(flat) - 1, 0))] == 0)) if len(flat) else np.zeros(0, np.int64)
        special = [i for i in special.tolist() if words[i].as_py()[1:].isdigit()]
        number = self.lexicon.numbers(flat, offsets)
        number[special] = -1
        new = np.flatnonzero(number < 0)
        merged, size = self.merger.ids(flat[spread(offsets[:-1][new].astype(np.int64), length[new])], length[new])
        own = np.concatenate([self.lexicon.ids, merged]) if len(merged) else self.lexicon.ids
        start, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        seen = np.flatnonzero(number >= 0)
        start[seen] = self.lexicon.at[number[seen]]
        count[seen] = self.lexicon.at[number[seen] + 1] - start[seen]
        start[new], count[new] = len(self.lexicon.ids) + np.cumsum(size) - size, size
        for i in special:  # a special token's string
            start[i], count[i], own = len(own), 1, np.append(own, np.uint32(words[i].as_py()[1:]))
        return np.cumsum(count) - count, count, own[spread(start, count)]

    def stretches(self, texts: list[str]):
        """The texts as stretches, each a ``Written``; a long text goes on in the next one."""
        for run in stretches(texts):
            words, number, per_text = self.split.occurrences([t for _, t in run])
            yield Written(run, per_text, number, *self.look_up(words))

    def written(self, texts: list[str]) -> list[tuple[str, str]]:
        """Per text: the decimal ids joined by spaces, and the decoded text."""
        parts = [(bytearray(), bytearray()) for _ in texts]
        for stretch in self.stretches(texts):
            for at, names in enumerate((self.numerals, self.spellings)):
                for i, data in stretch.joined(names):
                    parts[i][at].extend(data)
        return [(a[:-1].decode("ascii"), b[:-1].decode("utf-8")) for a, b in parts]


_encoders: dict = remembered.setdefault(__name__, {})  # the latest only


def encoder(path: str, blob: bytes) -> Encoder:
    """One per worker process and lexicon: tasks that follow each other in a worker share what it remembers."""
    key = (path, hashlib.blake2b(blob).digest())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, Lexicon.mapped(blob))
    return _encoders[key]


def frequent_words(docs: DataFrame, path: str, text_col: str = "text", most: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all texts, ``most`` of them or fewer: all words above the count at which they fit.

    Words are counted in full over all texts. The driver sees how many words have each count, and the words above
    the cut, which ``most`` bounds.
    """

    def count(batches):
        split, held, rows = Splitter(path), [], 0

        def summed():
            table = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
            return pa.table({"word": table.column("word"), "n": table.column("n_sum")})

        for batch in batches:
            for run in stretches([t for t in batch.column(0).to_pylist() if t]):
                words, number, _ = split.occurrences([t for _, t in run])
                short = (np.diff(flat_bytes(words)[1]) <= LEXICON_BYTES) & ~pc.starts_with(words, SPECIAL).to_numpy(zero_copy_only=False)
                held.append(pa.table({"word": words, "n": np.bincount(number, minlength=len(words))}).filter(pa.array(short)))
                rows += len(held[-1])
                if rows > COUNTED:
                    held = [summed()]
                    rows = len(held[0])
                    if rows > COUNTED // 2:
                        yield from held[0].to_batches()
                        held, rows = [], 0
        if held:
            yield from summed().to_batches()

    counts = docs.select(F.col(text_col)).mapInArrow(tidy(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = keep(counts.filter("n > 1"), "word-counts")
    room, least = most, None
    for r in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        if r["words"] > room:
            break
        room, least = room - r["words"], r["n"]
    return [] if least is None else [r["word"] for r in counts.filter(F.col("n") >= least).select("word").collect()]


def compile_lexicon(words: list[str], path: str) -> bytes:
    flat, offsets = flat_bytes(pa.array(words, pa.string()))
    ids, count = Merger(path).ids(flat[: offsets[-1]], np.diff(offsets).astype(np.int64))
    ends, ids = np.cumsum(count).tolist(), ids.tolist()
    return build({w.encode("utf-8"): ids[b - n : b] for w, b, n in zip(words, ends, count.tolist())})


def _encoded(docs: DataFrame, id_col: str, text_col: str, vocabulary: str | None, most: int, emit, more) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    path = vocabulary or default_vocabulary()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    blob = spark.sparkContext.broadcast(compile_lexicon(frequent_words(rows, path, "text", most), path))
    schema = rows.select("doc_id").schema
    for name, kind in more:
        schema = schema.add(name, kind)
    names = schema.fieldNames()

    def run(batches):
        mine = encoder(path, blob.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *emit(mine, texts)], names=names)

    return rows.mapInArrow(tidy(run), schema)


def _id_lists(mine: Encoder, texts: list[str]) -> list[pa.Array]:
    size, parts = np.zeros(len(texts), np.int64), []
    for stretch in mine.stretches(texts):
        for i, ids in stretch.id_arrays():
            size[i] += len(ids)
            parts.append(ids)
    flat = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
    return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat))]


def _ids_and_text(mine: Encoder, texts: list[str]) -> list[pa.Array]:
    return [*_id_lists(mine, texts), pa.array([b for _, b in mine.written(texts)], pa.string())]


def _digests(mine: Encoder, texts: list[str]) -> list[pa.Array]:
    n = np.zeros(len(texts), np.int64)
    sums = [(hashlib.sha256(), hashlib.sha256()) for _ in texts]
    for stretch in mine.stretches(texts):
        size = np.diff(np.concatenate([[0], np.cumsum(stretch.count[stretch.number])])[stretch.ends])
        for at, names in enumerate((mine.numerals, mine.spellings)):
            for (i, data), more in zip(stretch.joined(names), size.tolist()):
                if more:  # the space behind the last id is left out, and made up for where the text goes on
                    sums[i][at].update(data[:-1] if not n[i] else b" " + bytes(data[:-1]))
        np.add.at(n, stretch.texts, size)
    return [pa.array(n), pa.array([a.hexdigest() for a, _ in sums], pa.string()), pa.array([b.hexdigest() for _, b in sums], pa.string())]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, lexicon_words: int = LEXICON_WORDS, decoded: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, ids (array of int) and, if asked for, decoded (what decoding these ids gives).

    Defined cases: a null text is empty and has no ids; rows are independent, so ties, null and repeated ids do
    not matter; an empty table gives an empty result; other columns are ignored.
    """
    ids = ("ids", T.ArrayType(T.IntegerType()))
    if decoded:
        return _encoded(docs, id_col, text_col, vocabulary, lexicon_words, _ids_and_text, [ids, ("decoded", "string")])
    return _encoded(docs, id_col, text_col, vocabulary, lexicon_words, _id_lists, [ids])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """As ``encode``, with digests of the ids and of the decoded text, taken in the worker, in their place."""
    return _encoded(docs, id_col, text_col, vocabulary, lexicon_words, _digests, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")])

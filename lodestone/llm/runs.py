"""Periodic runs of words in texts.

A suffix automaton is built over the words; the end positions of its states are ordered sets that are merged from long states to short
ones, the smaller set into the larger one. Two ends of a state that become neighbours at a distance of no more than the
state's length stand for a square, which is extended both ways to a run. For each run the two copies of its longest
repeated part become neighbours in the state of that part, so every run is found by its smallest period.

Before that, words are put aside that no run can hold: a run of at least 2k words and twice its period is covered by
passages of k words that the same text has twice. What is left, in stretches, goes through the automaton.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import groups, small_batches, tidy

#: The fewest words of a run.
LEAST = 12
#: End positions of one block of an ordered set.
BLOCK = 512
#: Which word stands at each place of a text, given its row's id and its number of words; None for all as they are.
Order = Callable[[object, int], np.ndarray | None]


class Automaton:
    """Suffix automaton of a word of numbers. Most states have one edge, which is held in arrays; others have a dictionary."""

    def __init__(self, word: list[int]):
        self.length, self.link, self.end = array("i", [0]), array("i", [-1]), array("i", [-1])
        self.letter, self.to, self.more = array("i", [-1]), array("i", [-1]), {}
        last = 0
        for i, c in enumerate(word):
            last = self._append(last, i, c)

    def _state(self, length: int, link: int, end: int) -> int:
        for column, value in ((self.length, length), (self.link, link), (self.end, end), (self.letter, -1), (self.to, -1)):
            column.append(value)
        return len(self.length) - 1

    def _after(self, s: int, c: int) -> int:
        """The state behind an edge, -1 if there is none."""
        if self.letter[s] == c:
            return self.to[s]
        return self.more[s].get(c, -1) if s in self.more else -1

    def _lead(self, s: int, c: int, to: int) -> None:
        if self.letter[s] in (-1, c):
            self.letter[s], self.to[s] = c, to
        else:
            self.more.setdefault(s, {})[c] = to

    def _append(self, last: int, i: int, c: int) -> int:
        new = self._state(i + 1, 0, i)
        p = last
        while p >= 0 and self._after(p, c) < 0:
            self._lead(p, c, new)
            p = self.link[p]
        if p < 0:
            return new
        q = self._after(p, c)
        if self.length[q] == self.length[p] + 1:
            self.link[new] = q
            return new
        twin = self._state(self.length[p] + 1, self.link[q], -1)
        self.letter[twin], self.to[twin] = self.letter[q], self.to[q]
        if q in self.more:
            self.more[twin] = dict(self.more[q])
        while p >= 0 and self._after(p, c) == q:
            self._lead(p, c, twin)
            p = self.link[p]
        self.link[q] = self.link[new] = twin
        return new


class Ends:
    """An ordered set of end positions, in blocks, so that an insertion moves few of them and tells its neighbours."""

    __slots__ = ("blocks", "firsts", "size")

    def __init__(self, end: int):
        self.blocks, self.firsts, self.size = [[end]], [end], 1

    def __iter__(self):
        for block in self.blocks:
            yield from block

    def add(self, end: int) -> tuple[int, int]:
        """Put in an end; the ones before and after it, -1 for none."""
        k = max(bisect_right(self.firsts, end) - 1, 0)
        block = self.blocks[k]
        i = bisect_left(block, end)
        before = block[i - 1] if i else self.blocks[k - 1][-1] if k else -1
        after = block[i] if i < len(block) else self.blocks[k + 1][0] if k + 1 < len(self.blocks) else -1
        block.insert(i, end)
        self.firsts[k] = block[0]
        self.size += 1
        if len(block) > BLOCK:
            half = len(block) // 2
            self.blocks.insert(k + 1, block[half:])
            self.firsts.insert(k + 1, block[half])
            del block[half:]
        return before, after


class Found:
    """Repetitions by period; a square inside one that is known already is not extended again."""

    def __init__(self, word: np.ndarray):
        self.word, self.known = word, {}

    def square(self, end: int, period: int) -> None:
        """The words end-period+1..end are those of end+1..end+period."""
        starts, ends = self.known.setdefault(period, ([], []))
        k = bisect_right(starts, end - period + 1)
        if k and ends[k - 1] > end + period:
            return
        a, b = self._left(end - period, period), self._right(end + 1, period) + period
        starts.insert(k, a)
        ends.insert(k, b)

    def _left(self, at: int, period: int) -> int:
        """The first place from which on, up to ``at``, words equal those a period later."""
        some = 32
        while at >= 0:
            low = max(at + 1 - some, 0)
            odd = np.flatnonzero(self.word[low : at + 1] != self.word[low + period : at + 1 + period])
            if len(odd):
                return low + int(odd[-1]) + 1
            at, some = low - 1, some * 2
        return 0

    def _right(self, at: int, period: int) -> int:
        """The first place from ``at`` on whose word is not that of a period later."""
        some, end = 32, len(self.word) - period
        while at < end:
            high = min(at + some, end)
            odd = np.flatnonzero(self.word[at:high] != self.word[at + period : high + period])
            if len(odd):
                return at + int(odd[0])
            at, some = high, some * 2
        return end

    def runs(self, least: int) -> list[tuple[int, int, int]]:
        """(start, length, period), by start: of repetitions of the same words the one of the smallest period."""
        best: dict[tuple[int, int], int] = {}
        for period in sorted(self.known, reverse=True):
            for a, b in zip(*self.known[period]):
                if b - a >= least:
                    best[a, b] = period
        return sorted((a, b - a, p) for (a, b), p in best.items())


def word_runs(word: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a word of numbers: length at least ``least`` and twice the smallest period."""
    made = Automaton(word.tolist())
    found, sets = Found(word), {}
    length, link, end = np.array(made.length), made.link, made.end
    for s in np.argsort(-length, kind="stable")[:-1].tolist():  # the start state is the shortest
        mine = sets.pop(s, None)
        into = link[s]
        if into == 0:
            continue
        theirs = sets.get(into)
        if theirs is None and end[into] >= 0:
            theirs = Ends(end[into])
        if mine is None:
            mine = (end[s],) if theirs is not None else Ends(end[s])
        if theirs is None:
            sets[into] = mine
            continue
        if not isinstance(mine, tuple) and mine.size > theirs.size:
            mine, theirs = theirs, mine
        most = int(length[into])
        for e in mine:
            before, after = theirs.add(e)
            if before >= 0 and e - before <= most:
                found.square(before, e - before)
            if after >= 0 and after - e <= most:
                found.square(e, after - e)
        sets[into] = theirs
    return found.runs(least)


class Words(NamedTuple):
    """The words of some texts, which are runs of ASCII other than white space, and how many each text has."""

    data: pa.Array
    per_text: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> "Words":
        raw = [t.encode("utf-8") for t in texts]
        flat = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        solid = (flat != 0x20) & ((flat < 0x09) | (flat > 0x0D))
        begins = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
        offsets = np.append((np.cumsum(solid) - solid)[begins], solid.sum()).astype(np.int32)
        data = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(flat[solid])])
        return cls(data, np.diff(np.searchsorted(begins, ends), prepend=0))


def repeated(word: np.ndarray, owner: np.ndarray, k: int) -> np.ndarray:
    """Which places are in a passage of ``k`` words that their own text has twice. Equal hashes of others only add places."""
    n = len(word) - k + 1
    if n < 2:
        return np.zeros(len(word), bool)
    key = np.zeros(n, np.uint64)
    for j in range(k):
        key = key * np.uint64(0x9E3779B97F4A7C15) + (word[j : j + n].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(29)
    key = (key ^ owner[:n].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)) * np.uint64(0xE7037ED1A0B428DB)
    whole = np.flatnonzero(owner[:n] == owner[k - 1 :])
    ordered = np.sort(key[whole])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(word), bool)
    at = np.minimum(np.searchsorted(twice, key[whole]), len(twice) - 1)
    hits = whole[twice[at] == key[whole]]
    edges = np.zeros(len(word) + 1, np.int64)
    np.add.at(edges, hits, 1)
    np.add.at(edges, hits + k, -1)
    return np.cumsum(edges[:-1]) > 0


class Text(NamedTuple):
    """A text's runs, and its words without what repeats, joined by single spaces, as bytes."""

    runs: list[tuple[int, int, int]]
    collapsed: memoryview


def texts_with_runs(texts: list[str], ids: list, least: int = LEAST, order: Order | None = None) -> list[Text]:
    """The runs of each of a few texts. ``order`` may put the words of a text in other places first."""
    words = Words.of(texts)
    ends = np.cumsum(words.per_text)
    starts = ends - words.per_text
    place = np.arange(int(ends[-1]) if len(ends) else 0)
    if order:
        for i, a, n in zip(ids, starts.tolist(), words.per_text.tolist()):
            if n and (own := order(i, n)) is not None:
                place[a : a + n] = a + own
    owner = np.repeat(np.arange(len(texts)), words.per_text)
    word = words.data.dictionary_encode().indices.to_numpy()[place]
    in_play = repeated(word, owner, least // 2)
    edge = np.ones(len(word) + 1, bool)
    edge[1:-1] = (in_play[1:] != in_play[:-1]) | (owner[1:] != owner[:-1])
    cuts = np.flatnonzero(edge)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    kept = np.ones(len(word), bool)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if in_play[a] and b - a >= least:
            i = int(owner[a])
            for s, n, q in word_runs(np.unique(word[a:b], return_inverse=True)[1], least):
                runs[i].append((a + s - int(starts[i]), n, q))
                kept[a + s + q : a + s + n] = False
    left = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(left), words.data.take(pa.array(place[kept])))
    joined = pc.binary_join(lists, pa.scalar(b" ", pa.binary()))
    _, offsets, data = joined.buffers()
    offsets = np.frombuffer(offsets, np.int32)[: len(texts) + 1].tolist() if len(texts) else [0]
    data = memoryview(data) if data is not None else memoryview(b"")
    return [Text(r, data[a:b]) for r, a, b in zip(runs, offsets, offsets[1:])]


def _with(docs: DataFrame, id_col: str, text_col: str, least: int, order: Order | None, more, emit) -> DataFrame:
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = rows.select("doc_id").schema
    for name, kind in more:
        schema = schema.add(name, kind)
    names = schema.fieldNames()

    def run(batches):
        for batch in batches:
            ids, at = batch.column("doc_id"), 0
            for some in groups([t or "" for t in batch.column("text").to_pylist()]):
                own = ids.slice(at, len(some))
                found = texts_with_runs(some, own.to_pylist(), least, order)
                yield pa.RecordBatch.from_arrays([own, *emit(found)], names=names)
                at += len(some)

    return rows.mapInArrow(tidy(run), schema)


RUN = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Per row of ``docs``: doc_id, runs (start, length and period in words, by start) and text without the repetitions of runs.

    A run is a stretch of words with smallest period q, of at least ``least`` and 2 q words, that no neighbouring word extends. The text
    has the words but those that some run holds behind its first q words, joined by single spaces.

    Defined cases: a null, empty or blank text has no words and no runs; rows are independent, so null and repeated ids, ties and
    repeated rows do not matter; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    if least < 4:
        raise ValueError("a run has four words at least")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def emit(found: list[Text]):
        lists = [[dict(zip(("start", "length", "period"), r)) for r in t.runs] for t in found]
        return [pa.array(lists, kind), pa.array([str(t.collapsed, "utf-8") for t in found], pa.string())]

    return _with(docs, id_col, text_col, least, None, [("runs", RUN), ("text", "string")], emit)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, order: Order | None = None) -> DataFrame:
    """As ``runs``, with the number of runs, the longest one (ties: smallest start, then period) and digests in place of lists and texts.

    exponent_milli is a thousand times length over period, rounded down; a text without runs has nulls. ``order`` puts words in
    other places first. Defined cases are those of ``runs``.
    """

    def emit(found: list[Text]):
        first = [min(t.runs, key=lambda r: (-r[1], r[0], r[2]), default=None) for t in found]
        columns = [pa.array([len(t.runs) for t in found], pa.int64())]
        columns += [pa.array([r and r[i] for r in first], pa.int64()) for i in range(3)]
        columns.append(pa.array([r and 1000 * r[1] // r[2] for r in first], pa.int64()))
        listed = ("".join(f"{s},{n},{q}\n" for s, n, q in sorted(t.runs, key=lambda r: (r[0], r[2]))) for t in found)
        columns.append(pa.array([hashlib.sha256(x.encode()).hexdigest() for x in listed], pa.string()))
        columns.append(pa.array([hashlib.sha256(t.collapsed).hexdigest() for t in found], pa.string()))
        return columns

    more = [(n, "long") for n in ("n_runs", "start", "length", "period", "exponent_milli")] + [("runs_sha256", "string"), ("collapsed_sha256", "string")]
    return _with(docs, id_col, text_col, least, order, more, emit)

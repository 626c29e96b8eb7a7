"""Token counts by the whole-token shortcut.

Before any text is read, every string of the vocabulary that could stand alone is encoded, and those that come out as their own one token are
proven whole. A pre-token that is one of them counts one without being merged; only the others of a stretch, each distinct one
once, are merged, exactly, for their counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Merger, flat_bytes
from .common import remembered, small_batches, tidy
from .words import WORD_END, Splitter, byte_letters, default_vocabulary, spread, stretches

#: Texts of more tokens than this are over the limit.
LIMIT = 2048


def whole_tokens(path: str) -> list[str]:
    """The words of the vocabulary that encode alone as one token, that of their own, each one proven by encoding it.

    A word has to pass the normalizer and the splitter as itself, and its letters have to merge into its own id: there are
    vocabulary strings that other merges get in the way of. The list is bounded by the vocabulary.
    """
    split, merger = Splitter(path), Merger(path)
    back = {c: b for b, c in enumerate(byte_letters())}
    words, own = [], []
    for i, name in merger.tokens.items():
        letters = name.removesuffix(WORD_END)
        if name.endswith(WORD_END) and letters and all(c in back for c in letters):
            try:
                words.append(bytes(back[c] for c in letters).decode("utf-8"))
            except UnicodeDecodeError:  # part of a character: no word
                continue
            own.append(i)
    seen, number, per_text = split.occurrences(words)
    ends = np.cumsum(per_text)
    alone = np.flatnonzero(per_text == 1)
    alone = [i for i, w in zip(alone.tolist(), seen.take(pa.array(number[ends[alone] - 1])).to_pylist()) if w == words[i]]
    if not alone:
        return []
    flat, offsets = flat_bytes(pa.array([words[i] for i in alone], pa.string()))
    ids, count = merger.ids(flat, np.diff(offsets).astype(np.int64))
    first = ids[np.cumsum(count) - count]
    return [words[i] for i, n, got in zip(alone, count.tolist(), first.tolist()) if n == 1 and got == own[i]]


class Counter:
    """Tokens of texts in one worker."""

    def __init__(self, path: str, whole: list[str]):
        self.split, self.merger, self.whole = Splitter(path), Merger(path), pa.array(whole, pa.string())

    def sizes(self, words: pa.StringArray) -> np.ndarray:
        """Tokens of each distinct word: one of those proven whole, and of special tokens' strings; the rest are merged."""
        size = np.ones(len(words), np.int64)
        rest = np.flatnonzero(~pc.is_in(words, value_set=self.whole).to_numpy(zero_copy_only=False))
        flat, offsets = flat_bytes(words)
        start, length = offsets[:-1].astype(np.int64)[rest], np.diff(offsets).astype(np.int64)[rest]
        plain = np.ones(len(rest), bool)
        for at in np.flatnonzero((length > 1) & (flat[np.minimum(start, max(len(flat) - 1, 0))] == 0)).tolist() if len(flat) else ():
            plain[at] = not words[int(rest[at])].as_py()[1:].isdigit()
        rest, start, length = rest[plain], start[plain], length[plain]
        size[rest] = self.merger.ids(flat[spread(start, length)], length)[1]
        return size

    def counts(self, texts: list[str]) -> np.ndarray:
        n = np.zeros(len(texts), np.int64)
        for run in stretches(texts):
            words, number, per_text = self.split.occurrences([t for _, t in run])
            before = np.concatenate([[0], np.cumsum(self.sizes(words)[number])])
            np.add.at(n, [i for i, _ in run], np.diff(before[np.concatenate([[0], np.cumsum(per_text)])]))
        return n


_counters: dict = remembered.setdefault(__name__, {})  # the latest only


def _counter(path: str, whole: list[str]) -> Counter:
    if path not in _counters:
        _counters.clear()
        _counters[path] = Counter(path, whole)
    return _counters[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    A narrow pass over the texts; what the driver proves and sends is bounded by the vocabulary.

    Defined cases: a null or empty text has no bytes and no tokens; rows are independent, so null and repeated ids, ties and repeated rows
    do not matter; a text of any length is counted whole, stretch by stretch; an empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = vocabulary or default_vocabulary()
    whole = spark.sparkContext.broadcast(whole_tokens(path))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))

    def run(batches):
        mine = _counter(path, whole.value)
        for batch in batches:
            n = mine.counts([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    schema = rows.select("doc_id", "n_bytes").schema.add("n_tokens", "long").add("over_limit", "boolean")
    return rows.mapInArrow(tidy(run), schema)

"""Splitting texts as the public word-BPE vocabulary does, whole batches at a time, and encoding word by word.

The vocabulary's normalizer (NFC, white-space runs to one space, lower case) and its splitting pattern act
locally, so a text's ids are those of its words in turn. Texts of characters on which Python and the library
surely agree are split here, in numpy over one array of code units; any other text (combining marks, rare scripts,
special-token strings) goes to the library's own normalizer and splitter, whole. The words of a batch become numbers into the
list of its distinct words, so that whatever is looked up or worked out for a word is done once a batch.
"""

from __future__ import annotations

import itertools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from .common import remembered

# Fixed value: the splitting pattern of the vocabulary file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Anything but plain ASCII and the composed Latin letters (whose lower case is one letter) needs the library.
ODD = regex.compile(r"[^\t\n\r\x20-\x7e¡-įı-ž‐-‧€]")
WORD_END = "</w>"
#: Characters of one stretch of texts that is split at once.
STRETCH = 1 << 21
#: What stands for a special token among words, before its id; no word has it before digits.
SPECIAL = "\0"

SPACE, LETTER, DIGIT, MARK, STRANGE = range(5)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The kind and the lower case of every code unit."""
    kind, lower = np.full(1 << 16, STRANGE, np.uint8), np.arange(1 << 16, dtype=np.uint16)
    for c in map(chr, range(0x20AD)):
        if not ODD.match(c):
            kind[ord(c)] = SPACE if c.isspace() else LETTER if regex.match(r"\p{L}", c) else DIGIT if regex.match(r"\p{N}", c) else MARK
            lower[ord(c)] = ord(c.lower())
    return kind, lower


KIND, LOWER = _tables()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: a rule, not a table."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of runs that begin at ``starts``, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def stretches(texts: list[str], chars: int = STRETCH):
    """Runs of (text number, stretch), of about so many characters each.

    Short texts go whole, several to a run. A longer one is cut before white space, where the splitting surely begins anew, so
    that a run's memory does not grow with a text; a stretch without white space stays whole.
    """
    run: list[tuple[int, str]] = []
    held = 0
    blank = regex.compile(r"[\t\n\r ]")
    for i, text in enumerate(texts):
        at = 0
        while at == 0 or at < len(text):
            end = len(text)
            if end - at > chars:
                found = blank.search(text, at + chars)
                end = found.start() if found else end
            if run and held + end - at > chars:
                yield run
                run, held = [], 0
            run.append((i, text[at:end] if at or end < len(text) else text))
            held += end - at
            at = end
            if not text:
                break
    if run:
        yield run


class Splitter:
    """Texts to normalized words; a special token's string comes out as SPECIAL and its id."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = {t["content"]: t["id"] for t in json.load(open(path, encoding="utf-8"))["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.most = max(self.library.get_vocab().values(), default=0)
        self.back = {c: b for b, c in enumerate(byte_letters())}

    def plain(self, text: str) -> bool:
        return "<|" not in text and ODD.search(text) is None

    def odd_words(self, text: str) -> list[str]:
        """Words of any text, by the library."""
        out: list[str] = []
        for part in self.cut.split(text) if self.special else [text]:
            if part in self.special:
                out.append(f"{SPECIAL}{self.special[part]}")
            elif part:
                pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                out += [bytes(self.back[c] for c in piece).decode("utf-8") for piece, _ in pieces]
        return out

    def occurrences(self, texts: list[str]) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
        """The distinct words of all texts, for each word in turn its number among these, and words per text."""
        joined = "\n".join(texts) + "\n\n"
        units = np.frombuffer(joined.encode("utf-16-le", "surrogatepass"), np.uint16)
        kind = KIND[units]
        if "<|" not in joined and kind.max() < STRANGE:
            found = [_plain_words(units, kind, np.fromiter(map(len, texts), np.int64, len(texts)))]
        else:
            found = []
            for plain, run in itertools.groupby(texts, self.plain):
                if plain:
                    own = list(run)
                    units = np.frombuffer(("\n".join(own) + "\n\n").encode("utf-16-le"), np.uint16)
                    found.append(_plain_words(units, KIND[units], np.fromiter(map(len, own), np.int64, len(own))))
                else:
                    lists = [self.odd_words(t) for t in run]
                    found.append((pa.array(itertools.chain.from_iterable(lists), pa.string()), np.array([len(x) for x in lists], np.int64)))
        words = found[0][0] if len(found) == 1 else pa.chunked_array([w for w, _ in found], pa.string()).combine_chunks()
        coded = words.dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(), np.concatenate([n for _, n in found])


def _plain_words(units: np.ndarray, kind: np.ndarray, lengths: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """All words of plain texts, which are joined by line breaks and end with two, and words per text."""
    low = LOWER[units]
    start = np.empty(len(low), bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == DIGIT
    # the short endings after an apostrophe that begins its run of marks
    at = np.flatnonzero((low == ord("'")) & start)
    one, two = low[at + 1], low[np.minimum(at + 2, len(low) - 1)]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    start[at[short | long] + 1] = False
    start[at[short] + 2] = True
    start[at[long] + 3] = True
    start &= kind != SPACE
    ends = np.cumsum(lengths + 1)
    begins = np.flatnonzero(start)
    per_text = np.diff(np.searchsorted(begins, ends), prepend=0)
    solid = kind != SPACE
    kept = low[solid]
    data = kept.tobytes().decode("utf-16-le").encode("utf-8")
    if len(data) == len(kept):
        offsets = np.flatnonzero(start[solid])
    else:
        width = 1 + (kept >= 0x80).astype(np.uint8) + (kept >= 0x800)
        offsets = (np.cumsum(width, dtype=np.int64) - width)[start[solid]]
    offsets = np.append(offsets, len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(data)), per_text


class LibraryWords:
    """Ids of texts through the library, which sees each distinct word of a stretch once, or not at all while it is remembered."""

    #: Above so many remembered words only those of the last stretch stay, which bounds a worker's memory.
    MOST = 300_000

    def __init__(self, path: str):
        self.split = Splitter(path)
        self.library = self.split.library
        self.letters = {b: ord(c) for b, c in enumerate(byte_letters())}
        self._forget()

    def _forget(self) -> None:
        self.known, self.at, self.ids = pa.array([], pa.string()), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _library(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of words, flat, and how many each has. Neither its normalizer nor its splitter would change a word."""
        model, letters = self.library.model, self.letters
        lists = [[t.id for t in model.tokenize(w.encode("utf-8").decode("latin-1").translate(letters))] if w[:1] != SPECIAL or not w[1:].isdigit() else [int(w[1:])] for w in words.to_pylist()]
        return np.fromiter(itertools.chain.from_iterable(lists), np.uint32), np.fromiter(map(len, lists), np.int64, len(lists))

    def look_up(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word's ids begin in ``self.ids``, and how many it has."""
        if len(self.known) > self.MOST:
            self._forget()
        row = pc.fill_null(pc.index_in(words, self.known), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(row < 0)
        if len(new):
            fresh = words.take(pa.array(new))
            ids, count = self._library(fresh)
            row[new] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, fresh])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(count)])
            self.ids = np.concatenate([self.ids, ids])
        return self.at[row], self.at[row + 1] - self.at[row]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for run in stretches(texts):
            words, number, per_text = self.split.occurrences([t for _, t in run])
            start, count = self.look_up(words)
            flat = self.ids[spread(start[number], count[number])]
            ends = np.concatenate([[0], np.cumsum(count[number])])[np.cumsum(per_text)]
            for (i, _), a, b in zip(run, [0, *ends.tolist()], ends.tolist()):
                out[i].append(flat[a:b])
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]


_memos: dict = remembered.setdefault("lodestone.llm.pfor", {})


def library_words(path: str) -> LibraryWords:
    """One per worker process: tasks that follow each other in a worker share what it remembers."""
    if path not in _memos:
        _memos[path] = LibraryWords(path)
    return _memos[path]

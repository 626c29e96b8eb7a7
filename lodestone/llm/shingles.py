"""Texts to weighted sets of word shingles, whole batches at a time, in numpy."""

from __future__ import annotations

import numpy as np

#: Shingles are known by so many bits; the bits above hold a text's number in its batch.
ID_BITS = 44
_POWERS = 4096
MULTIPLIER = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; changes ``x`` in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_power = np.cumprod(np.full(_POWERS, MULTIPLIER, np.uint64), dtype=np.uint64)
_letter = np.zeros(256, bool)
_letter[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32


def word_hashes(texts: list[str], in_place: bool = False):
    """Hashes of the words of all texts, words per text, byte offsets of words (in the texts joined by one space).

    Words are runs of letters and digits in lower case; ``in_place`` folds ASCII letters only, which moves no byte.
    """
    raw = [(t if in_place else t.lower()).encode("utf-8", "replace") for t in texts]
    flat = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    flat = _fold[flat] if in_place else flat
    inside = _letter[flat]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    per_text = np.diff(np.searchsorted(start, ends), prepend=0)
    if not len(start):
        return np.zeros(0, np.uint64), per_text, start, end
    length = end - start
    at = np.flatnonzero(inside)
    place = at - np.repeat(start, length)
    value = (flat[at].astype(np.uint64) + np.uint64(1)) * _power[place % _POWERS]
    hashes = np.add.reduceat(value, np.cumsum(length) - length)
    return mix64(hashes + length.astype(np.uint64)), per_text, start, end


def shingle_lists(texts: list[str], words: int = 5):
    """(ids, sizes): all shingles of each text, sorted, repeats included; ``sizes`` per text.

    A text of fewer words than a shingle has one shingle of all of them; a text without words has none.
    """
    key = _keys(texts, words)
    sizes = np.bincount((key >> np.uint64(ID_BITS)).astype(np.int64), minlength=len(texts))
    return key & np.uint64((1 << ID_BITS) - 1), sizes


def _keys(texts: list[str], words: int) -> np.ndarray:
    """All shingles, each below the number of its text, sorted."""
    hashes, per_text, _, _ = word_hashes(texts)
    n = len(hashes)
    owner = np.repeat(np.arange(len(texts)), per_text)
    first = np.cumsum(per_text) - per_text
    place = np.arange(n) - first[owner]
    begins = place <= np.maximum(per_text - words, 0)[owner]
    at = np.flatnonzero(begins)
    who = owner[at]
    stop = (first + per_text)[who]
    total = np.zeros(len(at), np.uint64)
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    for j in range(words):
        part = padded[at + j]
        part = np.where(at + j < stop, part, np.uint64(7))
        total = total * np.uint64(0xBF58476D1CE4E5B9) + part
    ids = mix64(total) >> np.uint64(64 - ID_BITS)
    return np.sort((who.astype(np.uint64) << np.uint64(ID_BITS)) | ids)


def shingle_sets(texts: list[str], words: int = 5):
    """(ids, counts, sizes): the distinct shingles of each text, sorted, with their counts; ``sizes`` per text."""
    key = _keys(texts, words)
    if not len(key):
        return key, np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    where = np.flatnonzero(fresh)
    counts = np.diff(np.append(where, len(key)))
    key = key[where]
    sizes = np.bincount((key >> np.uint64(ID_BITS)).astype(np.int64), minlength=len(texts))
    return key & np.uint64((1 << ID_BITS) - 1), counts, sizes

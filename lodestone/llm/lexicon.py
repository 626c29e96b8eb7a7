"""A minimal acyclic transducer from words to vocabulary ids.

Words are added in byte order; finished states are shared with equal ones already registered, so common endings
are stored once. Each edge carries how many words sort before those behind it, so walking a word's bytes adds
up to the word's number, and the number leads to its ids. The automaton is one byte string of flat arrays, made
to be memory-mapped, and is walked for many words at once.
"""

from __future__ import annotations

import mmap
import os
import struct
import tempfile

import numpy as np

MAGIC = b"LXA1"
ORDER = (("keys", np.uint64), ("to", np.uint32), ("skip", np.uint32), ("final", np.uint8), ("at", np.uint32), ("ids", np.uint32))


def build(entries: dict[bytes, list[int]]) -> bytes:
    """Compile words (as bytes) with their ids; the start state is 0."""
    finals: list[bool] = []
    edges: list[tuple[tuple[int, int], ...]] = []
    registry: dict[tuple, int] = {}

    def settle(node) -> int:
        final, out = node
        key = (final, tuple(out))
        if key not in registry:
            registry[key] = len(finals)
            finals.append(final)
            edges.append(key[1])
        return registry[key]

    path: list[list] = [[False, []]]  # unsettled states along the last word
    last = b""
    for word in sorted(entries):
        same = len(os.path.commonprefix([last, word]))
        for depth in range(len(last), same, -1):
            path[depth - 1][1].append((last[depth - 1], settle(path.pop())))
        for _ in word[same:]:
            path.append([False, []])
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        path[depth - 1][1].append((last[depth - 1], settle(path.pop())))
    root = settle(path[0])

    count = [0] * len(finals)  # states are settled after all that they lead to
    for s in range(len(finals)):
        count[s] = finals[s] + sum(count[t] for _, t in edges[s])
    turn = len(finals) - 1  # the root is settled last; numbers are turned so that it becomes 0
    keys, to, skip = [], [], []
    for s in range(root, -1, -1):
        before = int(finals[s])
        for label, t in edges[s]:
            keys.append(((turn - s) << 8) | label)
            to.append(turn - t)
            skip.append(before)
            before += count[t]
    outs = [entries[w] for w in sorted(entries)]
    arrays = {
        "keys": keys, "to": to, "skip": skip, "final": finals[::-1],
        "at": np.concatenate([[0], np.cumsum([len(x) for x in outs])]) if outs else [0], "ids": [i for x in outs for i in x],
    }
    raw = [np.asarray(arrays[n], kind) for n, kind in ORDER]
    head = MAGIC + struct.pack("<6Q", *[len(a) for a in raw])
    body = b""
    for a in raw:
        body += b"\0" * (-(len(head) + len(body)) % 8) + a.tobytes()
    return head + body


class Lexicon:
    """A compiled automaton over a buffer, which may be a memory map."""

    def __init__(self, buffer):
        if bytes(buffer[:4]) != MAGIC:
            raise ValueError("not a lexicon")
        at = 4 + 48
        for (name, kind), n in zip(ORDER, struct.unpack_from("<6Q", buffer, 4)):
            at += -at % 8
            setattr(self, name, np.frombuffer(buffer, kind, n, at))
            at += n * np.dtype(kind).itemsize

    @classmethod
    def mapped(cls, blob: bytes) -> "Lexicon":
        """Put the automaton in a file of this worker and map it; the name goes at once, the pages stay."""
        with tempfile.NamedTemporaryFile() as f:
            f.write(blob)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def numbers(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number in byte order of each word, -1 for unseen ones; word i is ``flat[offsets[i]:offsets[i + 1]]``. All words advance by one byte at a time."""
        start = offsets[:-1].astype(np.int64)
        length = offsets[1:] - start
        out = np.full(len(start), -1, np.int64)
        if not len(self.final):
            return out
        live = np.arange(len(start))
        state, number = np.zeros(len(start), np.uint64), np.zeros(len(start), np.int64)
        depth = 0
        while len(live):
            ends = length[live] == depth
            done = ends & (self.final[state.astype(np.int64)] > 0)
            out[live[done]] = number[done]
            live, state, number = live[~ends], state[~ends], number[~ends]
            if not len(live) or not len(self.keys):
                break
            key = (state << np.uint64(8)) | flat[start[live] + depth].astype(np.uint64)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            live, at = live[hit], at[hit]
            state, number = self.to[at].astype(np.uint64), number[hit] + self.skip[at]
            depth += 1
        return out

    def find(self, words: list[bytes]) -> list[list[int] | None]:
        """Each word's ids, None for unseen words."""
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
        number = self.numbers(np.frombuffer(b"".join(words), np.uint8), offsets)
        return [self.ids[self.at[n] : self.at[n + 1]].tolist() if n >= 0 else None for n in number.tolist()]

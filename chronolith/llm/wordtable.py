"""Ids of whole batches of texts, a word at a time: each distinct word is encoded once a worker and its ids are gathered."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

from . import textkernel as K


def joined(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([len(x) for x in ids], np.int32), np.fromiter(chain.from_iterable(ids), np.uint32)


class WordTable:
    """Words are runs without ASCII white space, known by both 64-bit states of their bytes. ``encode`` takes a list of words as bytes and returns
    the number of ids of each and all their ids in order. Holds at most about ``most`` words (some 40 bytes each), then starts over."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 2_000_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.hashes, self.checks = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.starts, self.lengths = np.empty(0, np.int64), np.empty(0, np.int32)
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0

    def add(self, at: np.ndarray, hashes: np.ndarray, checks: np.ndarray, words: list[bytes]) -> None:
        lengths, ids = self.encode(words)
        total = len(ids)
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(max(total, self.used) + (1 << 16), np.uint32)])
        self.flat[self.used : self.used + total] = ids
        starts = self.used + np.cumsum(lengths, dtype=np.int64) - lengths
        self.used += total
        self.hashes, self.checks = np.insert(self.hashes, at, hashes), np.insert(self.checks, at, checks)
        self.starts, self.lengths = np.insert(self.starts, at, starts), np.insert(self.lengths, at, lengths)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned 32-bit), and the offset of each text in them."""
        w = K.words(data, offsets)
        if not len(w.start):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        states, checks = K.range_states(data, w.start, w.end)
        hashes, first, which = np.unique(states, return_index=True, return_inverse=True)
        if len(self.hashes) > self.most:
            self.clear()
        at = np.searchsorted(self.hashes, hashes)
        new = np.ones(len(hashes), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != hashes[inside]
        check = checks[first]
        if (check[which] != checks).any() or (self.checks[at[~new]] != check[~new]).any():
            return self.apart(data, w)
        if new.any():
            raw = data.tobytes()
            self.add(at[new], hashes[new], check[new], [raw[a:b] for a, b in zip(w.start[first[new]].tolist(), w.end[first[new]].tolist(), strict=True)])
            at = np.searchsorted(self.hashes, hashes)
        lengths = self.lengths[at][which].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        place = np.repeat(self.starts[at][which] - ends[:-1], lengths) + np.arange(ends[-1])
        return self.flat[place], ends[np.concatenate([[0], np.cumsum(w.count)])]

    def apart(self, data: np.ndarray, w: K.Words) -> tuple[np.ndarray, np.ndarray]:
        """The same, each word encoded for itself: for batches where different words agree in one state."""
        raw = data.tobytes()
        lengths, ids = self.encode([raw[a:b] for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)])
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        return np.asarray(ids, np.uint32), ends[np.concatenate([[0], np.cumsum(w.count)])]

"""A bounded cache of words' token ids, kept flat so that whole arrays of words are looked up at once."""

from __future__ import annotations

from collections.abc import Hashable, Sequence
from itertools import chain, repeat

import numpy as np

#: Words held before the rarely used ones go.
CACHED_WORDS = 400_000


class WordCache:
    def __init__(self, most: int = CACHED_WORDS):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.known: dict[Hashable, int] = {}
        self.ids, self.at, self.filled = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0
        self.hits = np.zeros(1 << 14, np.int64)

    def shrink(self) -> None:
        """Beyond ``most`` words only those stay that were used again since the last time, at most half of it."""
        n = len(self.known)
        if n <= self.most:
            return
        hits = self.hits[:n]
        least = max(2, int(np.partition(hits, n - self.most // 2)[n - self.most // 2]) + 1)
        keep = hits >= least
        words = [w for w, k in zip(self.known, keep.tolist()) if k]
        flat, sizes = self.gather(np.flatnonzero(keep))
        self.clear()
        self.add(words, flat, sizes)

    def find(self, every: Sequence[Hashable]) -> np.ndarray:
        """Numbers of the words, -1 for unknown ones."""
        return np.fromiter(map(self.known.get, every, repeat(-1)), np.int64, len(every))

    def learn(self, words: list[Hashable], found: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.add(words, np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes)

    def add(self, words: list[Hashable], flat: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.known)
        while len(self.at) < n + len(words) + 1:
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
            self.hits = np.concatenate([self.hits, np.zeros_like(self.hits)])
        while len(self.ids) < self.filled + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.filled : self.filled + len(flat)] = flat
        self.at[n + 1 : n + len(words) + 1] = self.filled + np.cumsum(sizes)
        self.filled += len(flat)
        self.known.update(zip(words, range(n, n + len(words))))

    def one(self, word: Hashable) -> list[int]:
        i = self.known[word]
        return self.ids[self.at[i] : self.at[i + 1]].tolist()

    def gather(self, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered words in a row, and how many each has."""
        starts, sizes = self.at[used], self.at[used + 1] - self.at[used]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)], sizes

    def use(self, used: np.ndarray) -> None:
        np.add(self.hits[: len(self.known)], np.bincount(used, minlength=len(self.known)), out=self.hits[: len(self.known)])

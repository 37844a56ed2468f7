"""Token ids of texts by way of their distinct chunks: each chunk is encoded once a task and looked up afterwards."""

from __future__ import annotations

from collections.abc import Callable, Hashable

import numpy as np


class Slots(dict):
    """Numbers keys in the order in which they are first asked for; new: those that nobody has fetched yet."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key: Hashable) -> int:
        at = self[key] = len(self)
        self.new.append(key)
        return at

    def of(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))

    def fetch_new(self) -> list:
        new, self.new = self.new, []
        return new


class PieceTable:
    """encode: new chunks -> a list of id lists. key: a 64-bit number kept by chunk. The table is emptied when it holds more than ``limit`` chunks, which bounds its memory."""

    def __init__(self, encode: Callable[[list], list], limit: int = 250_000, key: Callable[[Hashable], int] | None = None):
        self.encode, self.limit, self.key = encode, limit, key
        self.clear()

    def clear(self) -> None:
        self.slot = Slots()
        self.keys = np.zeros(1024, np.uint64)
        self.starts, self.counts, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0

    def add(self, new: list) -> None:
        lists = self.encode(new)
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        have, total = len(self.slot) - len(new), int(counts.sum())
        while have + len(new) > len(self.starts):
            self.starts, self.counts, self.keys = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts, self.keys))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.starts[have : have + len(new)] = self.used + np.cumsum(counts) - counts
        self.counts[have : have + len(new)] = counts
        if self.key:
            self.keys[have : have + len(new)] = np.array([self.key(c) for c in new], np.uint64)
        self.flat[self.used : self.used + total] = np.fromiter((i for x in lists for i in x), np.int32, total)
        self.used += total

    def slots(self, chunks: list) -> np.ndarray:
        """Where each chunk is; holds until the next call."""
        if len(self.slot) > self.limit:
            self.clear()
        at = self.slot.of(chunks)
        if new := self.slot.fetch_new():
            self.add(new)
        return at

    def ids(self, chunks: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, one after the other, and how many each has."""
        return self.at(self.slots(chunks))

    def at(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.counts[slots]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[slots] - (ends - n), n) + np.arange(total)], n

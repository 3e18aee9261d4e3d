"""Ids of the pieces (words) a worker has met, kept up to a bound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start[i] : start[i] + size[i]] one after another."""
    total = np.cumsum(size)
    if not len(total) or not total[-1]:
        return values[:0]
    return values[np.arange(total[-1]) + np.repeat(start - np.concatenate([[0], total[:-1]]), size)]


class Pieces:
    """Hashes with the place of their ids; over ``bound``, those met once since the last time go."""

    def __init__(self, bound: int):
        self.bound = bound
        self.clear()

    def clear(self) -> None:
        self.hash, self.again = np.zeros(0, np.uint64), np.zeros(0, bool)
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _find(self, distinct: np.ndarray) -> np.ndarray:
        return pc.index_in(pa.array(distinct), value_set=pa.array(self.hash)).fill_null(-1).to_numpy().astype(np.int64)

    def _keep(self, which: np.ndarray) -> None:
        start, size = self.start[which], self.size[which]
        self.hash, self.again = self.hash[which], np.zeros(len(size), bool)
        self.start, self.size, self.ids = np.cumsum(size) - size, size, gather(self.ids, start, size)

    def places(self, distinct: np.ndarray) -> np.ndarray:
        """Places of some distinct hashes, -1 for those to be added; makes room for them."""
        at = self._find(distinct)
        self.again[at[at >= 0]] = True
        if len(self.hash) and len(self.hash) + (at < 0).sum() > self.bound:
            self._keep(np.flatnonzero(self.again))
            if len(self.hash) + (at < 0).sum() > self.bound:
                self.clear()
            at = self._find(distinct)
        return at

    def add(self, h: np.ndarray, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """``ids`` holds count[i] ids for h[i], in order; returns their places."""
        known = len(self.hash)
        self.hash, self.again = np.concatenate([self.hash, h]), np.concatenate([self.again, np.zeros(len(h), bool)])
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
        self.size = np.concatenate([self.size, count])
        self.ids = np.concatenate([self.ids, ids])
        return np.arange(known, len(self.hash))

    def fill(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces at those places, limits of each piece's ids)."""
        size = self.size[at]
        return gather(self.ids, self.start[at], size), np.concatenate([[0], np.cumsum(size)])

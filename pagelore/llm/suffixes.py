"""Suffix orders by prefix doubling, in which only rows that still share their prefix are sorted again."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from pagelore.llm.anchors import groups


def heads(new: np.ndarray) -> np.ndarray:
    """Of each row of sorted groups, where its group begins."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else np.zeros(0, np.int64)


class Suffixes:
    """Rows in the order of their first ``width`` symbols; rank is the slot of the first row with the same ones."""

    def __init__(self, key: np.ndarray, width: int, shift: Callable[[np.ndarray, int], np.ndarray]):
        """key: a number for the first width symbols of each row; shift(rows, k): the rows k symbols further on."""
        self.width, self.shift = width, shift
        self.order = np.argsort(key)
        new = groups(key[self.order])
        self.rank = np.empty(len(key), np.int64)
        self.rank[self.order] = heads(new)
        #: Slots whose rows are not told apart yet.
        self.open = np.flatnonzero(self._shared(new))

    @staticmethod
    def _shared(new: np.ndarray) -> np.ndarray:
        return ~(new & np.append(new[1:], True)) if len(new) else new

    def to(self, depth: int) -> Suffixes:
        """Orders by ``depth`` symbols at least."""
        while self.width < depth and len(self.open):
            rows = self.order[self.open]
            pair = self.rank[rows] << 32 | self.rank[self.shift(rows, self.width)]
            sort = np.argsort(pair)
            rows, new = rows[sort], groups(pair[sort])
            self.order[self.open] = rows
            self.rank[rows] = self.open[heads(new)]
            self.open = self.open[self._shared(new)]
            self.width *= 2
        self.width = max(self.width, depth) if not len(self.open) else self.width
        return self


def along(n: int) -> Callable[[np.ndarray, int], np.ndarray]:
    """The shift of plain suffixes; what lies past the end is the last row."""
    return lambda rows, k: np.minimum(rows + k, n - 1)

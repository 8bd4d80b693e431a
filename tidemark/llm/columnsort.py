"""Column-wise ordering of many strings at once: one symbol of every string per round.

After the round of a column the strings stand in the order of their suffixes from that column on, and ``common`` holds
how many symbols each shares with the one before it. A round needs the last one's order and values only: strings with
equal symbols keep their order, and two of them that become neighbours share one symbol more than the least value
between their old places. (The symbols read in that order are the collection's Burrows-Wheeler transform for suffixes
of that length; columns are read from last to first, each once.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class RangeMinimum:
    """Least value of any range of an array, from the minima of all ranges of 2**k entries."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Over first to last, both included."""
        power = np.frexp(last - first + 1)[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        for k in np.unique(power):
            at = np.flatnonzero(power == k)
            out[at] = np.minimum(self.levels[k][first[at]], self.levels[k][last[at] - (1 << int(k)) + 1])
        return out


def rounds(columns: Iterator[np.ndarray], n: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(order, common) after each column, given from last to first; common is cut off at ``most`` (of order[0]: 0)."""
    order = np.arange(n)
    common = np.zeros(n, np.int16)
    for column in columns:
        symbol = column[order]
        moved = np.argsort(symbol, kind="stable")
        ordered = symbol[moved]
        same = np.flatnonzero(ordered[1:] == ordered[:-1]) + 1
        fresh = np.zeros(n, np.int16)
        if len(same):
            least = RangeMinimum(common)
            fresh[same] = np.minimum(least(moved[same - 1] + 1, moved[same]) + 1, most)
        order, common = order[moved], fresh
        yield order, common

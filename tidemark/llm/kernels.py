"""Array helpers for text columns inside Arrow tasks: slices of whole texts, words, rolling hashes.

All hashes are 64-bit polynomials over bytes, mixed at the end. They depend on content alone, so every task on every
machine gives a text the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Whole texts are worked on together up to this many bytes; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20

# Space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, size: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < size:
        steps = np.full(max(size, SLICE_BYTES + 1), _BASE if kind == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        have = _powers[kind] = np.multiply.accumulate(steps)
    return have[:size]


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (a new array)."""
    v = values ^ (values >> np.uint64(30))
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


class Rolling:
    """Hashes of any byte ranges of one buffer in constant time each."""

    def __init__(self, data: np.ndarray) -> None:
        self.down = _power("down", len(data) + 1)
        terms = (data.astype(np.uint64) + np.uint64(1)) * _power("up", len(data) + 1)[:-1]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(terms, out=self.sums[1:])

    def __call__(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return mix((self.sums[stops] - self.sums[starts]) * self.down[starts])

    def every(self, width: int) -> np.ndarray:
        """Of each position that has ``width`` bytes after it."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts; a null counts as empty."""
    array = pc.fill_null(column, "")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_string(array.type)
    _, places, values = array.buffers()
    if len(array) == 0:
        return
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[array.offset:array.offset + len(array) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(array):
        stop = int(np.searchsorted(offsets, int(offsets[first]) + limit, "right")) - 1
        stop = min(max(stop, first + 1), len(array))
        base = int(offsets[first])
        yield first, stop, data[base:int(offsets[stop])], (offsets[first:stop + 1] - offsets[first]).astype(np.int64)
        first = stop


def owners(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which text of the slice each byte position lies in."""
    return np.searchsorted(offsets[1:], positions, "right")


def word_spans(data: np.ndarray, offsets: np.ndarray,
               gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, text) of every word, a run without ``gap`` bytes (ASCII white space) inside one text."""
    ink = ~gap[data]
    begins, ends = ink.copy(), ink.copy()
    begins[1:] &= ~ink[:-1]
    ends[:-1] &= ~ink[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    begins[cuts] = ink[cuts]
    ends[cuts - 1] = ink[cuts - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, owners(starts, offsets)


def per_text(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sum of values by owner, for ``n`` texts."""
    return np.bincount(owner, weights=values, minlength=n) if len(owner) else np.zeros(n)


def shingle_hashes(words: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of each run of ``width`` words inside one text."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rolled = words[:n].copy()
    for k in range(1, width):
        rolled = mix(rolled) + words[k:n + k]
    firsts = np.flatnonzero(owner[:n] == owner[width - 1:])
    return mix(rolled[firsts]), firsts


def code_points(data: np.ndarray) -> np.ndarray:
    """Number of code points that begin before each byte position (one more entry than bytes)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out

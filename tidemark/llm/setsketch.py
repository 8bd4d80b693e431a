"""SetSketch registers of many sets at once, their bands, and the joint likelihood of two sketches."""

from __future__ import annotations

import numpy as np

from .kernels import mix

# Registers in bands of ROWS. A pair at the similarity limit 0.75 shares no band with chance (1 - 0.75**3)**30 < 1e-7.
ROWS, BANDS = 3, 30
REGISTERS = ROWS * BANDS
# Values grow by one where the minimum falls by this factor; close to 1, equal registers are as likely as the
# similarity of the sets.
BASE = 1.001
TOP = 65534
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _unit(values: np.ndarray) -> np.ndarray:
    return ((values >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def minima(elements: np.ndarray, owner: np.ndarray, sets: int) -> np.ndarray:
    """Least arrival time in each register of each set (sets x REGISTERS).

    Every element is the seed of a Poisson process of rate REGISTERS whose arrivals fall on registers at random, so a
    register's minimum is exponential with the set's size as rate, independently of the others. A process is followed
    only to a bound that all registers of its set pass with overwhelming odds; sets with an empty register go again
    with a wider bound, so the result is that of unbounded processes.
    """
    out = np.full(sets * REGISTERS, np.inf)
    size = np.bincount(owner, minlength=sets)
    bound = (np.log(REGISTERS) + 5) / np.maximum(size, 1)
    todo = np.arange(len(elements))
    while len(todo):
        state, who = elements[todo].copy(), owner[todo]
        limit = bound[who]
        clock = np.zeros(len(todo))
        while len(state):
            state = mix(state + _GOLD)
            clock = clock - np.log(_unit(state)) / REGISTERS
            alive = clock < limit
            state, who, clock, limit = state[alive], who[alive], clock[alive], limit[alive]
            place = (mix(state ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(REGISTERS)).astype(np.int64)
            np.minimum.at(out, who * REGISTERS + place, clock)
        short = np.isinf(out.reshape(sets, REGISTERS)).any(axis=1) & (size > 0)
        out.reshape(sets, REGISTERS)[short] = np.inf
        bound *= 2
        todo = np.flatnonzero(short[owner])
    return out.reshape(sets, REGISTERS)


def registers(elements: np.ndarray, owner: np.ndarray, sets: int) -> np.ndarray:
    """Register values: truncated, exponentially spaced; the register of a union is the larger of the two."""
    least = minima(elements, owner, sets)
    with np.errstate(divide="ignore"):
        level = np.floor(1 - np.log(least) / np.log(BASE)) + 32768
    return np.clip(np.where(np.isinf(least), 0, level), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def bands(values: np.ndarray) -> np.ndarray:
    """One 64-bit bucket per band (sets x BANDS); equal only for equal registers of that band."""
    shaped = values.reshape(len(values), BANDS, ROWS).astype(np.uint64)
    key = np.zeros((len(values), BANDS), np.uint64)
    for k in range(ROWS):
        key = (key << np.uint64(16)) | shaped[:, :, k]
    return mix(key * np.uint64(64) + np.arange(BANDS, dtype=np.uint64))


def joint_similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Most likely similarity of pairs of sets, given their registers (rows) and sizes.

    With shares u and v of the two sizes, a register of the first is the larger one with chance P(u - v J), and
    likewise for the second, where P(x) = -log_b(1 - x (b - 1) / b); the likelihood of the counts is greatest where
    its slope in J changes sign, found by bisection. Needs only the counts of larger, smaller and equal registers.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    total = size_a + size_b
    u, v = size_a / total, size_b / total
    scale = (BASE - 1) / BASE

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-12, 1) * scale) / np.log(BASE)

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):
        j = (low + high) / 2
        x, y = np.clip(u - v * j, 1e-12, 1), np.clip(v - u * j, 1e-12, 1)
        p, q = chance(x), chance(y)
        dp = -v * scale / (1 - x * scale) / np.log(BASE)
        dq = -u * scale / (1 - y * scale) / np.log(BASE)
        rising = more * dp / p + less * dq / q - same * (dp + dq) / np.maximum(1 - p - q, 1e-12) > 0
        low, high = np.where(rising, j, low), np.where(rising, high, j)
    return (low + high) / 2

"""Logistic regression on hashed features: fitted on a bounded sample, kept as one weight array."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Linear:
    """Weights, intercept, and the calibration line that turns a margin into a log-odds."""

    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, margins: np.ndarray) -> np.ndarray:
        z = self.slope * (margins + self.intercept) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _margins(rows: np.ndarray, index: np.ndarray, value: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=value * weights[index], minlength=n)


def fit(rows: np.ndarray, index: np.ndarray, value: np.ndarray, target: np.ndarray, size: int,
        rounds: int = 120, rate: float = 0.5, ridge: float = 1e-4, held_out: np.ndarray | None = None) -> Linear:
    """Fit P(target = 1) on sparse rows (row, feature, value) by full-batch Adam steps.

    Targets may lie between 0 and 1. Classes weigh alike. ``held_out`` marks rows that only fit the calibration line (two Newton-fitted numbers).
    With no row of one class the model is constant: the share of ones.
    """
    n = len(target)
    held = np.zeros(n, bool) if held_out is None else held_out
    if n == 0 or not 0 < target[~held].sum() < (~held).sum():
        share = float(np.clip(target.mean() if n else 0.5, 1e-3, 1 - 1e-3))
        return Linear(np.zeros(size), float(np.log(share / (1 - share))))
    share = target[~held].mean()
    balance = np.where(held, 0.0, target * 0.5 / share + (1 - target) * 0.5 / (1 - share))
    balance /= balance.sum()
    weights, bias = np.zeros(size), 0.0
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(_margins(rows, index, value, weights, n) + bias, -40, 40)))
        gap = (p - target) * balance
        slope = np.append(np.bincount(index, weights=value * gap[rows], minlength=size) + ridge * weights / n, gap.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope * slope
        move = rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
        weights -= move[:-1]
        bias -= move[-1]
    model = Linear(weights, float(bias))
    if held.any() and 0 < target[held].sum() < held.sum():
        z = (_margins(rows, index, value, weights, n) + bias)[held]
        model = Linear(weights, float(bias), *calibrate(z, target[held]))
    return model


def calibrate(margin: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the log-odds line, with smoothed targets so that separable rows stay finite."""
    ones = target.sum()
    goal = np.where(target == 1, (ones + 1) / (ones + 2), 1 / (len(target) - ones + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        d, w = p - goal, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[np.dot(w, margin * margin) + 1e-6, np.dot(w, margin)], [np.dot(w, margin), w.sum() + 1e-6]])
        move = np.linalg.solve(h, np.array([np.dot(d, margin), d.sum()]))
        norm = np.abs(move).max()
        move *= min(1.0, 2.0 / norm) if norm > 0 else 1.0
        a, b = a - move[0], b - move[1]
        if norm < 1e-8:
            break
    return float(a), float(b)

"""Cutting stock by column generation over a bounded number of length classes."""

from __future__ import annotations

import numpy as np


def price(duals: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern worth most: an unbounded knapsack over class sizes 1..n, by dynamic programming."""
    n = len(duals)
    best = np.zeros(capacity + 1)
    take = np.zeros(capacity + 1, np.int64)  # class taken last; 0 leaves one unit empty
    for c in range(1, capacity + 1):
        most = min(n, c)
        values = duals[:most] + best[c - 1 :: -1][:most]
        k = int(values.argmax())
        best[c], take[c] = (values[k], k + 1) if values[k] > best[c - 1] + 1e-12 else (best[c - 1], 0)
    pattern = np.zeros(n, np.int64)
    c = capacity
    while c > 0:
        if take[c]:
            pattern[take[c] - 1] += 1
            c -= take[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def solve(demand: np.ndarray, capacity: int, rounds: int = 20_000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often to use each, for the least number of bins (fractional).

    ``demand[i]`` items have size i + 1. Starts with one-class patterns; each round the duals price all patterns
    and the best enters the basis, until none improves. Classes without demand are left out of the program.
    Stopping at ``rounds`` would leave a feasible answer.
    """
    sizes = np.flatnonzero(demand)
    if not len(sizes):
        return []
    need = demand[sizes].astype(float)
    patterns = [np.where(np.arange(len(sizes)) == i, capacity // (s + 1), 0) for i, s in enumerate(sizes)]
    basis = np.array(patterns, float).T
    inverse = np.diag(1 / np.diag(basis))
    used = inverse @ need
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        worth = np.zeros(int(sizes[-1]) + 1)
        worth[sizes] = np.maximum(duals, 0)
        value, column = price(worth, capacity)
        if value <= 1 + 1e-9:
            break
        column = column[sizes]
        move = inverse @ column
        grows = move > 1e-9
        if not grows.any():
            break
        ratio = np.where(grows, used / np.where(grows, move, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        used = used - step * move
        used[out] = step
        row = inverse[out] / move[out]
        inverse = inverse - np.outer(move, row)
        inverse[out] = row
        patterns[out] = column
    full = []
    for pattern, times in zip(patterns, used, strict=True):
        wide = np.zeros(len(demand), np.int64)
        wide[sizes] = pattern
        if times > 1e-9:
            full.append((wide, float(times)))
    return full

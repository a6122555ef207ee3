"""Scores into shares that rise with them."""

from __future__ import annotations

import numpy as np


def isotonic(scores: np.ndarray, counts: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over rising scores: middles of the pools and their smoothed shares."""
    pools: list[list[float]] = []
    for s, n, h in zip(scores, counts, hits, strict=True):
        pools.append([s * n, n, h])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    sums, n, h = np.array(pools).T
    return sums / n, np.maximum.accumulate((h + 0.5) / (n + 1))

"""Warping distances over batches of sequence pairs, in NumPy.

The loops run over the cells of the cost matrix; each cell is one vector operation over all pairs of a batch, so a batch of
a few thousand pairs costs about as much as a handful of single ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

KINDS = ("euclidean", "sq_euclidean", "city_block", "tmm")


def cost(a: np.ndarray, b: np.ndarray, kind: str) -> np.ndarray:
    """Point distances, element by element."""
    d = np.abs(a - b)
    if kind == "sq_euclidean":
        return d * d
    if kind == "tmm":
        return np.minimum(d % 53.0, 53.0 - d % 53.0)
    if kind in ("euclidean", "city_block"):
        return d
    raise ValueError(f"unknown distance {kind}")


@dataclass(frozen=True)
class Warp:
    """How a path may run.

    band: cells with |i - j| up to it, widened to the difference of the lengths; None for all cells.
    local: steps (2,1), (1,1), (1,2) instead of (1,0), (1,1), (0,1), from the third row and column on.
    open_ends: the path may start anywhere in the first row or column and end in the last ones, within the band.
    """

    band: int | None = None
    local: bool = False
    open_ends: bool = False
    kind: str = "sq_euclidean"


def matrices(x: np.ndarray, y: np.ndarray, warp: Warp) -> np.ndarray:
    """Accumulated costs of every pair: (pairs, n) and (pairs, m) give (n, m, pairs)."""
    pairs, n = x.shape
    m = y.shape[1]
    band = max(n, m) if warp.band is None else max(warp.band, abs(n - m))
    out = np.full((n, m, pairs), np.inf)
    xt, yt = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    for i in range(n):
        for j in range(max(0, i - band), min(m, i + band + 1)):
            d = cost(xt[i], yt[j], warp.kind)
            if i == 0 and j == 0 or warp.open_ends and (i == 0 or j == 0):
                out[i, j] = d
                continue
            if warp.local and i >= 2 and j >= 2:
                best = np.minimum(np.minimum(out[i - 2, j - 1], out[i - 1, j - 1]), out[i - 1, j - 2])
            else:
                best = np.full(pairs, np.inf)
                for a, b in ((i - 1, j - 1), (i - 1, j), (i, j - 1)):
                    if a >= 0 and b >= 0:
                        best = np.minimum(best, out[a, b])
            out[i, j] = d + best
    return out


def ends(costs: np.ndarray, warp: Warp) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance and last cell of the best path of every pair."""
    n, m, pairs = costs.shape
    if not warp.open_ends:
        return costs[n - 1, m - 1], np.full(pairs, n - 1), np.full(pairs, m - 1)
    band = max(n, m) if warp.band is None else max(warp.band, abs(n - m))
    cells = [(n - 1, j) for j in range(max(0, m - 1 - band), m)] + [(i, m - 1) for i in range(max(0, n - 1 - band), n - 1)]
    values = np.stack([costs[c] for c in cells])
    pick = values.argmin(axis=0)
    where = np.array(cells)[pick]
    return values[pick, np.arange(pairs)], where[:, 0], where[:, 1]


def distances(x: np.ndarray, y: np.ndarray, warp: Warp) -> np.ndarray:
    """Warping distance of every pair. Without local steps and open ends only two rows of costs are kept."""
    pairs, n = x.shape
    m = y.shape[1]
    if not pairs:
        return np.zeros(0)
    if warp.local or warp.open_ends:
        return ends(matrices(x, y, warp), warp)[0]
    band = max(n, m) if warp.band is None else max(warp.band, abs(n - m))
    xt, yt = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    before = np.full((m + 1, pairs), np.inf)
    before[0] = 0.0
    for i in range(n):
        now = np.full((m + 1, pairs), np.inf)
        for j in range(max(0, i - band), min(m, i + band + 1)):
            best = np.minimum(before[j], before[j + 1])
            np.minimum(best, now[j], out=best)
            now[j + 1] = cost(xt[i], yt[j], warp.kind) + best
        before = now
    return before[m]


def path(costs: np.ndarray, last: tuple[int, int], warp: Warp) -> list[tuple[int, int]]:
    """The best path of one pair's cost matrix, from its start; of equal steps the diagonal one is taken, then j - 1."""
    i, j = last
    out = [(i, j)]
    while i > 0 or j > 0:
        if warp.open_ends and (i == 0 or j == 0):
            break
        if warp.local and i >= 2 and j >= 2:
            steps = [(i - 1, j - 1), (i - 1, j - 2), (i - 2, j - 1)]
        else:
            steps = [(a, b) for a, b in ((i - 1, j - 1), (i, j - 1), (i - 1, j)) if a >= 0 and b >= 0]
        i, j = min(steps, key=lambda s: costs[s])
        out.append((i, j))
    return out[::-1]


def distance_along(x: np.ndarray, y: np.ndarray, cells: list[tuple[int, int]], kind: str = "sq_euclidean") -> float:
    """Sum of point distances over a given path."""
    i, j = np.array(cells).T
    return float(cost(x[i], y[j], kind).sum())


def envelope(x: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest and smallest values within ``half`` samples, for every sequence of (pairs, n)."""
    high, low = x.copy(), x.copy()
    for k in range(1, min(half, x.shape[1] - 1) + 1):
        for to, by, pick in ((high, x, np.maximum), (low, x, np.minimum)):
            pick(to[:, k:], by[:, :-k], out=to[:, k:])
            pick(to[:, :-k], by[:, k:], out=to[:, :-k])
    return high, low


def keogh(upper: np.ndarray, lower: np.ndarray, y: np.ndarray, kind: str = "sq_euclidean") -> np.ndarray:
    """LB_Keogh of every pair: distance of y to the envelope where it lies outside."""
    above, below = np.maximum(y - upper, 0.0), np.maximum(lower - y, 0.0)
    out = above + below
    return (out * out if kind == "sq_euclidean" else out).sum(axis=1)

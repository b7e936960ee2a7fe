"""Distance kernels used inside tasks.

``screen`` gives a fast matrix of distance scores with a bound on its rounding
error; ``exact`` re-evaluates chosen pairs with one fixed summation order, so
equal vectors always score equally wherever they are compared.
Scores are squared for euclidean and cosine (order-preserving).
"""

from __future__ import annotations

import numpy as np

#: Cells of a distance tile: it stays in a core's cache, and a task holds a few of them at most.
TILE_CELLS = 1 << 19
#: Cells that are summed axis by axis at a time.
SUM_CELLS = 1 << 16
#: Coordinates up to here may be screened in single precision.
SINGLE_MAX = 1e30


def prepare(points: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        norms = np.linalg.norm(points, axis=1, keepdims=True)
        return points / np.where(norms == 0.0, 1.0, norms)
    return points


def screen(a: np.ndarray, b: np.ndarray, metric: str, single: bool = False, sq_b: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Scores of all pairs and a bound on their rounding error.

    ``single`` sums manhattan distances in single precision (with a wider bound); ``sq_b`` are the squared lengths of ``b``.
    """
    if metric == "manhattan":
        scale = max(float(np.abs(a).max(initial=0.0)), float(np.abs(b).max(initial=0.0)))
        dim = a.shape[1]
        if single and scale < SINGLE_MAX:
            return _manhattan(a, b, np.float32), 4 * np.finfo(np.float32).eps * dim * (dim + 2) * scale + 1e-40 * dim
        return _manhattan(a, b, np.float64), 1e-12 * (1e-300 + scale * dim)
    sq_a = squares(a)
    sq_b = squares(b) if sq_b is None else sq_b
    out = a @ b.T
    out *= -2.0
    out += sq_a[:, None]
    out += sq_b
    scale = float(sq_a.max(initial=0.0) + sq_b.max(initial=0.0))
    return out, 1e-12 * scale + 1e-300


def squares(a: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, a)


def planar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all pairs in a few dimensions, from their differences."""
    out = np.zeros((len(a), len(b)))
    gap = np.empty_like(out)
    for axis in range(a.shape[1]):
        np.subtract(a[:, axis, None], b[None, :, axis], out=gap)
        gap *= gap
        out += gap
    return np.sqrt(out, out=out)


def _manhattan(a: np.ndarray, b: np.ndarray, kind: type) -> np.ndarray:
    """Sums over axes in the order of the axes, in pieces that stay in the cache."""
    left, right = np.ascontiguousarray(a.T, kind), np.ascontiguousarray(b.T, kind)
    out = np.zeros((len(a), len(b)), kind)
    width = max(1, min(len(b), 2048))
    height = max(1, SUM_CELLS // width)
    buffer = np.empty((height, width), kind)
    for r in range(0, len(a), height):
        for c in range(0, len(b), width):
            whole = out[r:r + height, c:c + width]
            gap, total = buffer[:whole.shape[0], :whole.shape[1]], np.zeros(whole.shape, kind)
            for axis in range(a.shape[1]):
                np.subtract(left[axis, r:r + height, None], right[axis, None, c:c + width], out=gap)
                np.abs(gap, out=gap)
                total += gap
            whole[...] = total
    return out


def exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Row-wise score of equally long pair lists."""
    diff = np.ascontiguousarray(a - b)
    return (np.abs(diff) if metric == "manhattan" else diff * diff).sum(axis=1)


def exact_pairs(a: np.ndarray, rows: np.ndarray, b: np.ndarray, cols: np.ndarray, metric: str) -> np.ndarray:
    """Scores of the pairs (a[rows], b[cols]), gathered in slices of bounded size."""
    step = max(1, TILE_CELLS // max(1, a.shape[1]))
    out = np.empty(len(rows))
    for at in range(0, len(rows), step):
        part = slice(at, at + step)
        out[part] = exact(a[rows[part]], b[cols[part]], metric)
    return out


def to_distance(score, metric: str):
    """Score -> reported distance."""
    if metric == "euclidean":
        return np.sqrt(score)
    return score / 2.0 if metric == "cosine" else score


def tiles(rows: int, cols: int):
    step = max(1, TILE_CELLS // max(cols, 1))
    for start in range(0, rows, step):
        yield slice(start, min(rows, start + step))

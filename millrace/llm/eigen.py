"""Leading eigenpairs of a symmetric matrix, whose size is that of one vector and not of the data.

Householder reflections make the matrix tridiagonal; Sturm counts bisect for the leading eigenvalues; inverse
iteration finds their vectors, made orthogonal to those of the same cluster of eigenvalues.
"""

from __future__ import annotations

import numpy as np

#: Eigenvalues closer than this share of the matrix norm form a cluster.
CLUSTER = 1e-3


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and the orthogonal matrix ``q`` with ``matrix = q @ t @ q.T``."""
    a, n = np.array(matrix, float), len(matrix)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v /= size
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def at_least(diagonal: np.ndarray, off: np.ndarray, points: np.ndarray, tiny: float) -> np.ndarray:
    """How many eigenvalues are not below each of ``points``, from the signs of the Sturm sequence."""
    below = np.zeros(len(points), int)
    pivot = np.ones(len(points))
    for k, d in enumerate(diagonal):
        pivot = d - points - (off[k - 1] ** 2 / pivot if k else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        below += pivot < 0
    return len(diagonal) - below


def leading_values(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, falling; all bisections advance together."""
    radius = np.abs(np.r_[0, off]) + np.abs(np.r_[off, 0])
    reach = float(np.max(np.abs(diagonal) + radius))
    tiny = reach * np.finfo(float).eps ** 2
    low, high = np.full(count, -reach), np.full(count, np.nextafter(reach, np.inf))
    wanted = np.arange(1, count + 1)
    while True:
        middle = (low + high) / 2
        if np.all((middle <= low) | (middle >= high)):
            return low
        enough = at_least(diagonal, off, middle, tiny) >= wanted
        low, high = np.where(enough, middle, low), np.where(enough, high, middle)


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit vectors as columns."""
    n, scale = len(matrix), float(np.abs(matrix).max(initial=0.0))
    if scale == 0.0:
        return np.zeros(min(count, n)), np.eye(n)[:, :count]
    diagonal, off, q = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, min(count, n))
    t = np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1)
    norm = float(np.abs(t).sum(axis=1).max())
    rng, found = np.random.default_rng(13), np.empty((n, 0))
    first = 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            first = k
        # Equal eigenvalues of a cluster are kept apart by a few units in the last place.
        shift = value - (k - first + 1) * np.finfo(float).eps * norm
        x, cluster = rng.standard_normal(n), found[:, first:]
        for _ in range(5):
            x = np.linalg.solve(t - shift * np.eye(n), x / np.linalg.norm(x))
            for _ in range(2):
                x -= cluster @ (cluster.T @ x)
        found = np.c_[found, x / np.linalg.norm(x)]
    vectors = q @ found
    return values * scale, vectors / np.linalg.norm(vectors, axis=0)

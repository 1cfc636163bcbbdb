"""Leading eigenvalues and eigenvectors of a small symmetric matrix, in numpy.

Householder reflections make the matrix tridiagonal, Sturm counts and bisection find the wanted
eigenvalues, inverse iteration finds their vectors; vectors of close eigenvalues are made orthogonal to
each other in every step. The matrix is as large as a vector is wide, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
#: Eigenvalues nearer to each other than this share of the norm form a cluster.
CLUSTER_GAP = 1e-3
#: Steps of inverse iteration; the second one usually ends it.
MOST_STEPS = 8


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors) with matrix = Q T Qᵀ and Q the product of the reflections.

    Reflector k (a unit vector over the last entries, empty where there was nothing to reflect) maps
    column k below the diagonal to a multiple of its first entry.
    """
    a = np.array(matrix, dtype=np.float64)
    size = len(a)
    reflectors = []
    for k in range(size - 2):
        below = a[k + 1 :, k]
        length = np.linalg.norm(below)
        if not np.any(below[1:]) or length == 0:
            reflectors.append(np.zeros(0))
            continue
        v = below.copy()
        v[0] += np.copysign(length, below[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        product = rest @ v
        half = product - (v @ product) * v
        rest -= 2.0 * (np.outer(v, half) + np.outer(half, v))
        a[k + 1 :, k] = 0.0
        a[k + 1, k] = -np.copysign(length, v[0])
        reflectors.append(v)
    return np.diagonal(a).copy(), np.diagonal(a, -1).copy(), reflectors


def turned_back(reflectors: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """Q times the columns of ``vectors``."""
    out = vectors.copy()
    for k in range(len(reflectors) - 1, -1, -1):
        v = reflectors[k]
        if len(v):
            out[k + 1 :] -= 2.0 * np.outer(v, v @ out[k + 1 :])
    return out


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each value of ``at``."""
    floor = EPS * max(np.abs(off).max(initial=0.0), np.finfo(np.float64).tiny / EPS)
    below = np.zeros(len(at), dtype=np.int64)
    q = np.ones(len(at))
    for i, d in enumerate(diagonal):
        q = d - at - (off[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < floor, -floor, q)
        below += q < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, falling, bisected until no double lies between the ends."""
    size = len(diagonal)
    reach = np.zeros(size)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    margin = EPS * size * max(np.abs(diagonal).max(), reach.max(initial=0.0)) + np.finfo(float).tiny
    low = np.full(count, (diagonal - reach).min() - margin)
    high = np.full(count, (diagonal + reach).max() + margin)
    # The k-th largest is above x if and only if fewer than size − k + 1 lie below x.
    rank = size - np.arange(1, count + 1)
    for _ in range(2000):
        middle = low + (high - low) / 2.0
        if np.all((middle <= low) | (middle >= high)):
            break
        above = sturm_counts(diagonal, off, middle) <= rank
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return low + (high - low) / 2.0


def _factored(diagonal: np.ndarray, off: np.ndarray, shift: float, floor: float):
    """A solver of (T − shift) x = b by elimination with row exchanges."""
    size = len(diagonal)
    main, upper, second = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * size
    factor, swapped = [0.0] * size, [False] * size
    for i in range(size - 1):
        low = float(off[i])
        if abs(low) > abs(main[i]):
            swapped[i] = True
            main[i], low = low, main[i]
            upper[i], main[i + 1] = main[i + 1], upper[i]
            second[i], upper[i + 1] = upper[i + 1], 0.0
        if main[i] == 0.0:
            main[i] = floor
        factor[i] = low / main[i]
        main[i + 1] -= factor[i] * upper[i]
        upper[i + 1] -= factor[i] * second[i]
    main = [m if abs(m) >= floor else (floor if m >= 0 else -floor) for m in main]

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.tolist()
        for i in range(size - 1):
            if swapped[i]:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= factor[i] * x[i]
        for i in range(size - 1, -1, -1):
            if i + 1 < size:
                x[i] -= upper[i] * x[i + 1]
            if i + 2 < size:
                x[i] -= second[i] * x[i + 2]
            x[i] /= main[i]
            if abs(x[i]) > 1e150:
                x = [v * 1e-150 for v in x]
        return np.array(x)

    return solve


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors, as columns, of the given falling eigenvalues of the tridiagonal matrix."""
    size = len(diagonal)
    norm = max(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    source = np.random.default_rng(1)
    vectors = np.zeros((size, len(values)))
    first, shift = 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER_GAP * norm:
            first = j
        # Equal shifts would lead to one vector; a few last places keep them apart.
        shift = value if j == first else min(value, shift - 10 * EPS * norm)
        solve = _factored(diagonal, off, shift, EPS * norm)
        x = source.uniform(-1.0, 1.0, size)
        settled = 0
        for _ in range(MOST_STEPS):
            x /= np.linalg.norm(x)
            y = solve(x)
            for _ in range(2):
                y -= vectors[:, first:j] @ (vectors[:, first:j].T @ y)
            grown = np.linalg.norm(y)
            x = y / grown
            settled += grown * norm * EPS * size > 0.01
            if settled > 1:
                break
        vectors[:, j] = x
    return vectors


def leading_eigen(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit vectors as columns."""
    size = len(matrix)
    count = min(count, size)
    if not count:
        return np.zeros(0), np.zeros((size, 0))
    diagonal, off, reflectors = tridiagonal(matrix)
    values = leading_values(diagonal, off, count)
    vectors = turned_back(reflectors, inverse_iteration(diagonal, off, values))
    return values, vectors / np.linalg.norm(vectors, axis=0)

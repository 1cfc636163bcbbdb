"""Direct definitions, for small inputs only."""

from itertools import combinations
from math import factorial

import numpy as np


def digamma(n: int) -> float:
    """The digamma function at a whole number."""
    return -0.5772156649015329 + sum(1.0 / i for i in range(1, n))


def neighbour_information(x, y, k: int) -> float:
    """Ross (2014): nearest neighbours within a class against all points within that distance.

    Where the distance is 0, all repeats count on both sides.
    """
    parts = []
    for i in range(len(x)):
        same = np.flatnonzero(y == y[i])
        if len(same) < 2:
            continue
        near = min(k, len(same) - 1)
        distance = np.sort(np.abs(x[same] - x[i]))[near]
        if distance == 0:
            near = int((x[same] == x[i]).sum()) - 1
            within = int((x == x[i]).sum())
        else:
            within = int((np.abs(x - x[i]) < distance).sum())
        parts.append(digamma(near) - digamma(len(same)) - digamma(max(within, 1)))
    return max(digamma(len(parts)) + np.mean(parts), 0.0)


def shapley(value, size: int) -> np.ndarray:
    """Shapley values of a set function by enumeration."""
    result = np.zeros(size)
    for i in range(size):
        others = [j for j in range(size) if j != i]
        for r in range(size):
            for chosen in combinations(others, r):
                weight = factorial(r) * factorial(size - r - 1) / factorial(size)
                result[i] += weight * (value({*chosen, i}) - value(set(chosen)))
    return result

"""Arithmetic on arrays of numbers, inside the engine's own expressions, and centroids of a sample on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(v: Column) -> Column:
    """Length of a vector."""
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """A vector of length one; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def kmeans(points: np.ndarray, k: int, steps: int = 8, seed: int = 0) -> np.ndarray:
    """k centroids (Lloyd), the same on every run; fewer points than k are their own centroids."""
    if len(points) <= k:
        return points.copy()
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(steps):
        own = nearest_centre(points, centres)
        order = np.argsort(own, kind="stable")
        counts = np.bincount(own, minlength=k)
        filled = np.nonzero(counts)[0]
        starts = (np.cumsum(counts) - counts)[filled]
        centres[filled] = np.add.reduceat(points[order], starts, axis=0) / counts[filled][:, None]
        for c in np.nonzero(counts == 0)[0]:
            centres[c] = points[rng.integers(len(points))]
    return centres


def nearest_centre(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of the nearest centroid of each point."""
    norms = (centres**2).sum(1)
    return np.concatenate([(norms - 2 * points[a : a + 8192] @ centres.T).argmin(1) for a in range(0, max(1, len(points)), 8192)])

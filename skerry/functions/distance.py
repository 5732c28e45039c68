"""Vector functions as columns, and the same in numpy for Arrow batches.

Sums run from the first coordinate to the last in double precision in both, so
results agree bit for bit.  The ``dot`` metric is the negated inner product, so
smaller is nearer for every metric.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(v: Column | Sequence[float]) -> Column:
    """An array column of doubles, from a column or from literal values."""
    if isinstance(v, Column):
        return v.cast("array<double>")
    if not len(v):
        return F.array().cast("array<double>")
    # One expression: a literal at a time would be a call to the JVM each.
    return F.expr(f"array({', '.join(_literal(float(x)) for x in v)})")


def _literal(x: float) -> str:
    return f"{x!r}D" if math.isfinite(x) else f"double('{x!r}')"


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def dot_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def dot_distance(a: Column, b: Column) -> Column:
    return -dot_product(a, b)


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def squared_norm(a: Column) -> Column:
    return _sum(F.transform(a, lambda x: x * x))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine similarity, the similarity held to [-1, 1]; 1 if a vector is zero."""
    norms = squared_norm(a) * squared_norm(b)
    similarity = dot_product(a, b) / F.sqrt(norms)
    return F.when(norms == 0, F.lit(1.0)).otherwise(1.0 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), similarity)))


def cosine_similarity(a: Column, b: Column) -> Column:
    return 1.0 - cosine(a, b)


def normalize(a: Column) -> Column:
    """The unit vector; a zero vector stays."""
    norm = F.sqrt(squared_norm(a))
    return F.when(norm == 0, a).otherwise(F.transform(a, lambda x: x / norm))


METRICS: dict[str, Callable[[Column, Column], Column]] = {"l2": l2_squared, "cosine": cosine, "dot": dot_distance, "manhattan": manhattan}


def metric(name: str) -> Callable[[Column, Column], Column]:
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; valid: {', '.join(METRICS)}")
    return METRICS[name]


def score(distance: Column, name: str) -> Column:
    """Similarity of a distance; 0 for an unknown metric."""
    if name == "l2":
        return 1.0 / (1.0 + F.sqrt(distance))
    if name == "cosine":
        return F.greatest(F.lit(0.0), 1.0 - distance / 2.0)
    if name == "dot":
        return (1.0 - distance) / 2.0
    if name == "manhattan":
        return 1.0 / (1.0 + distance)
    return F.lit(0.0)


def exact(a: np.ndarray, b: np.ndarray, name: str) -> np.ndarray:
    """Distances of paired rows, in the columns' order of summation."""
    total, na, nb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for j in range(a.shape[1]):
        x, y = a[:, j], b[:, j]
        if name == "l2":
            total += (x - y) * (x - y)
        elif name == "manhattan":
            total += np.abs(x - y)
        else:
            total += x * y
            if name == "cosine":
                na += x * x
                nb += y * y
    if name == "dot":
        return -total
    if name == "cosine":
        norms = na * nb
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(norms == 0, 1.0, 1.0 - np.clip(total / np.sqrt(norms), -1.0, 1.0))
    return total


def rough(queries: np.ndarray, rows: np.ndarray, name: str) -> np.ndarray:
    """(queries, rows) distances by matrix product, to choose candidates only."""
    if name == "manhattan":
        return np.stack([np.abs(rows - q).sum(axis=1) for q in queries])
    inner = queries @ rows.T
    if name == "dot":
        return -inner
    nq, nr = (queries**2).sum(axis=1)[:, None], (rows**2).sum(axis=1)[None]
    if name == "l2":
        return nq + nr - 2 * inner
    norms = nq * nr
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(norms == 0, 1.0, 1.0 - np.clip(inner / np.sqrt(norms), -1.0, 1.0))

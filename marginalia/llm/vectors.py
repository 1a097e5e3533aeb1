"""Helpers of the two vector operators: usable vectors, pivots, cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """True for a vector with at least one component and no null or non-finite one."""
    v = F.col(vector)
    bad = F.exists(
        v,
        lambda x: x.isNull()
        | F.isnan(x)
        | (F.abs(x.cast("double")) == F.lit(float("inf"))),
    )
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True))


def stack(column, width: int) -> np.ndarray:
    """A list column whose rows all have ``width`` entries as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, width).astype(np.float64)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by the largest part first, so nothing overflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def spread_out(points: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first choice of at most ``count`` different points."""
    chosen = [0]
    gap = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(points)):
        nxt = int(gap.argmax())
        if gap[nxt] <= 0:
            break
        chosen.append(nxt)
        gap = np.minimum(gap, ((points - points[nxt]) ** 2).sum(axis=1))
    return points[chosen]


def pivots(df: DataFrame, vector: str, count: int, sample: int, shape=unit) -> dict[int, np.ndarray]:
    """At most ``count`` pivots for each vector length, from a sample of ``sample`` vectors.

    The sample is what an order by hash puts first, so it does not depend on partitions. Only
    the sample comes to the driver: at most ``sample`` vectors however large the table is.
    """
    taken = df.select(vector).orderBy(F.xxhash64(vector)).limit(sample).toArrow().column(0).to_pylist()
    out: dict[int, np.ndarray] = {}
    for width in sorted({len(v) for v in taken}):
        points = shape(np.array([v for v in taken if len(v) == width], np.float64))
        out[width] = spread_out(points, count)
    return out


def to_pivots(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Euclidean distances of every point to every pivot."""
    squares = (points**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None] - 2 * points @ centres.T
    return np.sqrt(np.maximum(squares, 0.0))

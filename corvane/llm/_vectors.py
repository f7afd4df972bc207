"""Vectors of whole numbers over Arrow lists, and sums of them a group (numpy and Spark)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Magnitude of a component up to which squared distances of 64 components fit a long.
MOST = 1 << 27
#: Whole numbers that doubles hold exactly.
EXACT = 1 << 53


def usable(vector: Column, scale: int) -> Column:
    """Whether a vector of doubles has no null and no non-finite component, and none of a magnitude over ``MOST`` once scaled."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) * scale < MOST, F.lit(False)) & ~F.isnan(x))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column without nulls, each of ``width`` values."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as a list column."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width) if width else np.zeros(n + 1), pa.int32()), pa.array(values.ravel(), kind))


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(values * float(scale)).astype(np.int64)


def floors(sums: np.ndarray, counts: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) where there is a count; else what was there before."""
    return np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], before)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all rows of ``y``; as doubles where those hold them, else as integers."""
    most = max((int(np.abs(v).max(initial=0)) for v in (x, y)), default=0)
    if 4 * x.shape[1] * most * most < EXACT:
        a, b = x.astype(np.float64), y.astype(np.float64)
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
    out = np.empty((len(x), len(y)), np.int64)
    for j in range(len(y)):
        d = x - y[j]
        out[:, j] = (d * d).sum(1)
    return out


def summed(rows: DataFrame, keys: Iterable[str]) -> Iterator[tuple]:
    """(keys, count, sums) of groups of bounded number, from rows (keys, count, sums) of tasks; sums are lists."""
    keys = list(keys)
    each = rows.select(*keys, "count", F.posexplode("sums").alias("at", "x")).groupBy(*keys, "at").agg(F.sum("count").alias("count"), F.sum("x").alias("x"))
    held: dict[tuple, tuple[int, dict[int, int]]] = {}
    for r in each.collect():
        held.setdefault(tuple(r[k] for k in keys), (r["count"], {}))[1][r["at"]] = r["x"]
    for key, (count, x) in held.items():
        yield *key, count, [x[i] for i in range(len(x))]

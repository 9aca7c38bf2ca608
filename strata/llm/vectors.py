"""Vectors as exact integers, shared by the operators over `embeddings`.

A component x becomes floor(256 * x) with x as a double.  A vector is left out
when it is null or holds a null, NaN or infinite component.  Vectors of
different lengths are compared as if the shorter ones ended in zeros.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SCALE = 256.0


def usable(vector: str = "embedding") -> Column:
    """Whether the vector is there and all its components are finite."""
    return F.col(vector).isNotNull() & F.forall(
        F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def whole(vector: str = "embedding") -> Column:
    """array<bigint>: floor(256 * x) of every component."""
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(SCALE)).cast("bigint"))


def matrix(column, dim: int) -> np.ndarray:
    """Rows of an array column (Arrow or pandas) as an int64 matrix of dim columns, shorter rows ending in zeros."""
    if isinstance(column, (pa.ListArray, pa.LargeListArray)):
        flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    else:
        rows = [np.asarray(v, np.int64) for v in column]
        flat, sizes = np.concatenate([np.zeros(0, np.int64), *rows]), np.array([len(v) for v in rows], np.int64)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def shape(vectors: DataFrame, column: str = "v") -> tuple[int, int, int]:
    """Rows, longest vector and largest absolute component of a table of whole vectors."""
    row = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(column)).alias("dim"),
                      F.max(F.greatest(F.abs(F.coalesce(F.array_max(column), F.lit(0))), F.abs(F.coalesce(F.array_min(column), F.lit(0))))).alias("top")).first()
    return row["n"], row["dim"] or 0, row["top"] or 0


def within(dim: int, top: int, factor: int) -> None:
    """Raise if sums of dim products of components up to top, times factor, could leave 64 bits."""
    if dim * top * top * factor >= 1 << 62:
        raise ValueError(f"components up to {top} in {dim} dimensions do not give scores of 64 bits")

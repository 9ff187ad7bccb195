"""Batches of vectors as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(id, v): vectors of `dim` finite values that are not all zero; other rows are set aside."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(v.isNotNull() & (F.size(v) == dim)).where(finite & F.exists(v, lambda x: x != 0))
    return kept.select(F.col(id_col).cast("long").alias("id"), v.cast("array<float>").alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of a list column, a row each."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)

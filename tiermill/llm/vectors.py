"""What the operators on ``embeddings`` share: which vectors count, and their components as integers in Arrow batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Beyond this a squared distance of 64 components may not fit into a long.
LIMIT = 1 << 27


def finite(c: Column) -> Column:
    """Is the vector there, with no null, NaN or infinite component?"""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(c.isNotNull() & ~bad, F.lit(False))


def grid(vectors: DataFrame, vec_col: str, scale: int) -> DataFrame:
    """The rows with a whole vector; ``vec_col`` becomes the array of ``floor(scale * x)``, as integers.  A component beyond
    +-2^27 raises: its squared distances would not fit into a long."""
    def integer(v):
        y = v.cast("double") * scale
        return F.when(F.abs(y) < LIMIT, F.floor(y).cast("int")).otherwise(
            F.raise_error(F.lit(f"a component times {scale} is beyond 2^27")).cast("int"))

    return vectors.where(finite(F.col(vec_col))).withColumn(vec_col, F.transform(vec_col, integer))


def matrix(column, dim: int) -> np.ndarray:
    """An Arrow column of integer arrays of ``dim`` components as rows of a matrix."""
    if not len(column):
        return np.zeros((0, dim), np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def squares(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of every row to every point, exact in 64 bits."""
    out = np.empty((len(rows), len(points)), np.int64)
    for k, p in enumerate(points):
        d = rows - p
        out[:, k] = np.einsum("ij,ij->i", d, d)
    return out


def add_up(sums: DataFrame, keys: list[str], dim: int) -> list:
    """Collect ``keys, n, total`` (an array of ``dim`` longs) summed by keys; the keys are few by construction (a codebook's
    entries or the centroids), so are the rows that reach the driver."""
    x = sums.select(*keys, "n", F.posexplode("total").alias("i", "t"))
    return x.groupBy(*keys, "i").agg(F.sum("n").alias("n"), F.sum(F.col("t").cast("decimal(38,0)")).alias("t")).collect()

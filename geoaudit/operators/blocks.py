"""All pairs of two sets of vectors, as blocks against blocks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors in a block, and rows of a block whose distances are held at once.
CELL = 8192
ROWS = 256


def paired(left: DataFrame, right: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Rows ``(i, j, dim, side, id, label, v)``: every block i of ``left`` (side 0) beside every block j of ``right`` (side 1).

    Rows with a null key or vector are in no block; vectors of different lengths
    do not meet.
    """

    def cut(df: DataFrame) -> tuple[DataFrame, int]:
        x = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
        n = max(1, math.ceil(x.count() / CELL))
        return x.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"), F.size(vector).alias("dim"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("own")), n

    (l, nl), (r, nr) = cut(left), cut(right)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    put = lambda df, i, j, side: df.select(i.alias("i"), j.alias("j"), "dim", F.lit(side).alias("side"), "id", "label", "v")
    own: Column = F.col("own")
    return put(l, own, every(nr), 0).union(put(r, every(nl), own, 1))


def sides(g: pa.Table) -> tuple[pa.Table, np.ndarray, pa.Table, np.ndarray]:
    """Both blocks of a pair, each with its matrix of doubles."""
    out = []
    for side in (0, 1):
        t = g.filter(pc.equal(g.column("side"), side)).combine_chunks()
        dim = g.column("dim")[0].as_py()
        out += [t, t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, dim) if t.num_rows else np.zeros((0, dim))]
    return tuple(out)


def exact(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (a, b) of rows, by differences."""
    out = np.zeros(len(a))
    for lo in range(0, len(a), 65536):
        at = slice(lo, lo + 65536)
        out[at] = ((x[a[at]] - y[b[at]]) ** 2).sum(1)
    return out


def squared(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of all pairs by a matrix product, and per row of x what their rounding may amount to."""
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    d = xx[:, None] + yy[None, :] - 2 * (x @ y.T)
    return np.maximum(d, 0, out=d), 1e-12 * (xx + (yy.max() if len(yy) else 0.0))

"""Principal components from Gram matrices that are added up where the rows are.

A task adds the products of its rows to one matrix, Spark adds the matrices row by
row, and what reaches the driver has as many numbers as two columns have pairs.  Rows
are measured from the first pass's means, so nothing cancels.  The fit may use a
hashed share of the rows and is applied to all.  Signs are fixed: a component's
largest loading (the first of equals) is positive.

Rows are left out as in :mod:`geoaudit.operators.mixtures`; fewer than two rows raise
ValueError; a column without spread stays as it is when columns are standardised.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoaudit.operators.mixtures import _matrix, vectors


@dataclass
class Components:
    """Means and scales of the columns, loadings (k x d), variances and their shares of the whole."""

    centre: np.ndarray
    scale: np.ndarray
    loadings: np.ndarray
    variances: np.ndarray
    shares: np.ndarray


def fit(df: DataFrame, key: str, vector: str, k: int, share: float = 1.0, seed: int = 42, standardise: bool = True) -> tuple[Components, DataFrame]:
    """The first ``k`` components of a hashed ``share`` of the rows, and ``(id, v)`` of all usable rows."""
    x, _, dim = vectors(df, key, vector)
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("bigint")
    some = x if share >= 1 else x.where(h < int(share * (1 << 32)))
    at = [F.col("v")[i] for i in range(dim)]
    stats = some.agg(F.count(F.lit(1)), *(f(a) for a in at for f in (F.avg, F.stddev_pop))).first()
    n = stats[0]
    if n < 2:
        raise ValueError(f"{n} rows have no components")
    centre, spread = np.array(stats[1::2], np.float64), np.array(stats[2::2], np.float64)
    scale = np.where(spread > 0, spread, 1.0) if standardise else np.ones(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            z = (_matrix(b.column("v"), dim) - centre) / scale
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "g"])

    parts = some.mapInArrow(run, "i int, g array<double>")
    gram = np.zeros((dim, dim))
    for r in parts.groupBy("i").agg(F.array(*(F.sum(F.col("g")[j]) for j in range(dim))).alias("g")).collect():  # d rows
        gram[r.i] = r.g
    values, axes = np.linalg.eigh((gram + gram.T) / (2 * (n - 1)))
    order = np.argsort(-values, kind="stable")[:k]
    loadings = axes[:, order].T
    sign = np.sign(loadings[np.arange(len(order)), np.abs(np.round(loadings, 9)).argmax(1)])
    return Components(centre, scale, loadings * sign[:, None], values[order], values[order] / values.sum()), x


def transformed(x: DataFrame, c: Components) -> DataFrame:
    """``(id, pc)``: the rows' coordinates."""
    kind = x.schema["id"].dataType.simpleString()
    dim = len(c.centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = ((_matrix(b.column("v"), dim) - c.centre) / c.scale) @ c.loadings.T
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(z.tolist(), pa.list_(pa.float64()))], names=["id", "pc"])

    return x.mapInArrow(run, f"id {kind}, pc array<double>")

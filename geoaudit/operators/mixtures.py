"""Gaussian mixtures with diagonal covariances: every round of every mixture is one aggregate.

The sufficient statistics (weight, sum and sum of squares of each component) are
added up in the tasks and then by Spark; what reaches the driver are the components.
Densities are taken in logarithms.  Values are measured from the table's mean, so
that the squares do not cancel.

Rows with a null key, vector or component are left out; all vectors have the length
of the shortest that is left, or the fit raises ValueError; a mixture with more
components than there are rows is not fitted; an empty table has none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoaudit.session import materialise


@dataclass
class Mixture:
    """Weights (k), means and variances (k x d), and how the fit went."""

    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    log_likelihood: float = -math.inf
    rounds: int = 0
    converged: bool = False

    def bic(self, n: int) -> float:
        """-2 log likelihood plus the parameters (weights, means, variances) times log n."""
        k, d = self.means.shape
        return -2 * self.log_likelihood + (k - 1 + 2 * k * d) * math.log(n)


def log_densities(x: np.ndarray, m: Mixture) -> np.ndarray:
    """Log of weight times density, by row and component."""
    d = ((x[:, None, :] - m.means[None]) ** 2 / m.variances[None]).sum(2)
    with np.errstate(divide="ignore"):
        return np.log(m.weights) - 0.5 * (d + np.log(2 * math.pi * m.variances).sum(1))


def responsibilities(x: np.ndarray, m: Mixture) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the components in each row, and the rows' log likelihoods."""
    p = log_densities(x, m)
    top = p.max(1, keepdims=True)
    total = top[:, 0] + np.log(np.exp(p - top).sum(1))
    return np.exp(p - total[:, None]), total


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def vectors(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, int, int]:
    """``(id, v)`` of the rows that can be used, written once; their number and the vectors' length."""
    v = F.col(vector).cast("array<double>")
    x = df.where(F.col(key).isNotNull() & v.isNotNull()).where(~F.exists(v, lambda e: e.isNull()))
    x = materialise(x.select(F.col(key).alias("id"), v.alias("v")), "vectors")
    n, low, high = x.agg(F.count(F.lit(1)), F.min(F.size("v")), F.max(F.size("v"))).first()
    if n and low != high:
        raise ValueError(f"vectors of {low} and of {high} values")
    return x, n, low or 0


def sums(x: DataFrame, models: dict[int, Mixture], centre: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """For each mixture the components' weights, sums and sums of squares, and the log likelihood: one pass for all."""
    dim = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = {k: [np.zeros((len(m.weights), 1 + 2 * dim)), 0.0] for k, m in models.items()}
        for b in batches:
            v = _matrix(b.column("v"), dim) - centre
            for lo in range(0, len(v), 4096):
                part = v[lo : lo + 4096]
                for k, m in models.items():
                    r, total = responsibilities(part, m)
                    got[k][0] += np.concatenate([r.sum(0)[:, None], r.T @ part, r.T @ (part * part)], 1)
                    got[k][1] += float(total.sum())
        rows = [(k, j, row.tolist(), total if j == 0 else 0.0) for k, (s, total) in got.items() for j, row in enumerate(s)]
        columns = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.list_(pa.float64())), pa.array(columns[3], pa.float64())], names=["k", "j", "s", "total"])

    parts = x.mapInArrow(run, "k int, j int, s array<double>, total double")
    added = parts.groupBy("k", "j").agg(F.array(*(F.sum(F.col("s")[i]) for i in range(1 + 2 * dim))).alias("s"), F.sum("total").alias("total"))
    out = {k: [np.zeros((len(m.weights), 1 + 2 * dim)), 0.0] for k, m in models.items()}
    for r in added.collect():  # the components
        out[r.k][0][r.j] = r.s
        out[r.k][1] += r.total
    return {k: (s[:, 0], s[:, 1 : 1 + dim], s[:, 1 + dim :], total) for k, (s, total) in out.items()}


def fit(df: DataFrame, key: str, vector: str, ks: list[int], rounds: int = 200, tolerance: float = 1e-3, ridge: float = 1e-4, seed: int = 42) -> tuple[dict[int, Mixture], int]:
    """Mixtures of the given sizes, and the number of rows.

    A mixture begins at the k rows least by ``md5("seed:k:key")`` with the table's
    variances; it ends when a round changes the mean log likelihood by less than
    ``tolerance``.  ``ridge`` is added to every variance.
    """
    x, n, dim = vectors(df, key, vector)
    if not n:
        return {}, 0
    at = [F.col("v")[i] for i in range(dim)]
    stats = x.agg(*(f(a) for a in at for f in (F.avg, F.var_pop))).first()
    centre, variance = np.array(stats[::2], np.float64), np.array(stats[1::2], np.float64)
    models, done = {}, {}
    for k in ks:
        if k <= n:
            h = F.md5(F.concat(F.lit(f"{seed}:{k}:"), F.col("id").cast("string")))
            first = np.array([r.v for r in x.orderBy(h, "id").limit(k).collect()], np.float64)  # k rows
            models[k] = Mixture(np.full(k, 1 / k), first - centre, np.tile(variance + ridge, (k, 1)))
    for turn in range(1, rounds + 1):
        for k, (w, s, ss, total) in sums(x, models, centre).items():
            m = models[k]
            ended = turn > 1 and abs(total - m.log_likelihood) / n < tolerance
            w = w + 10 * np.finfo(float).eps
            means = s / w[:, None]
            models[k] = Mixture(w / w.sum(), means, np.maximum(ss / w[:, None] - means * means, 0) + ridge, total, turn, ended)
            if ended:
                done[k] = models.pop(k)
        if not models:
            break
    done |= models
    # the likelihood of the components as they are at the end
    for k, (_, _, _, total) in sums(x, done, centre).items():
        done[k].log_likelihood = total
    for m in done.values():
        m.means = m.means + centre
    return {k: done[k] for k in ks if k in done}, n


def selection(df: DataFrame, key: str, vector: str, ks: list[int], **how: float) -> DataFrame:
    """``(k, log_likelihood, bic)`` of a mixture of each size."""
    models, n = fit(df, key, vector, ks, **how)
    rows = [(k, float(m.log_likelihood), float(m.bic(n))) for k, m in models.items()]
    return df.sparkSession.createDataFrame(rows, "k int, log_likelihood double, bic double")


def assigned(df: DataFrame, key: str, vector: str, model: Mixture) -> DataFrame:
    """``(key, component, share)``: the likeliest component of each usable row."""
    x, _, dim = vectors(df, key, vector)
    kind = x.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r, _ = responsibilities(_matrix(b.column("v"), dim), model)
            at = r.argmax(1)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(at.astype(np.int64)), pa.array(r[np.arange(len(at)), at])], names=["id", "component", "share"])

    return x.mapInArrow(run, f"id {kind}, component long, share double").withColumnRenamed("id", key)

"""K-means by mini batches: all starts and all resamples in the same passes.

Rows are dealt to batches by a hash of their ids and written by batch, so that a
round reads one batch and nothing else.  A centre moves to the mean of all rows that
it was given so far (its count is its learning rate).  Starts are drawn from an
oversample: ``OVER`` rows for every centre, least by hash, of which k are chosen one
after the other with probability in proportion to the squared distance from those
chosen before.  All draws are portable hashes, so a fit can be repeated elsewhere.

Ids are integers; otherwise rows are left out as in :mod:`geoaudit.operators.mixtures`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoaudit.operators.mixtures import _matrix, vectors
from geoaudit.session import new_folder

#: Rows of the oversample for every centre.
OVER = 16
_U = np.uint64


def scrambled(ids: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each id (xor-shift and multiply), the same on every machine."""
    x = ids.astype(np.int64).view(_U) + _U((seed * 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Run:
    """One fit: its seed, the share of the rows it may see, and its centres."""

    seed: int
    share: float = 1.0
    starts: int = 3
    centres: list[np.ndarray] = field(default_factory=list)  # one array for each start
    counts: list[np.ndarray] = field(default_factory=list)

    def sees(self, ids: np.ndarray) -> np.ndarray:
        return (scrambled(ids, self.seed) >> _U(11)).astype(np.float64) < self.share * (1 << 53)


def nearest(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row (the first of equals) and its squared distance."""
    d = (v * v).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * v @ centres.T
    at = d.argmin(1)
    return at, ((v - centres[at]) ** 2).sum(1)


def seeded(ids: np.ndarray, v: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres from an oversample."""
    order = np.lexsort((ids, scrambled(ids, seed)))
    v = v[order]
    chosen = [0]
    d = ((v - v[0]) ** 2).sum(1)
    while len(chosen) < min(k, len(v)):
        u = float(scrambled(np.array([len(chosen)]), seed + 1)[0] >> _U(11)) / (1 << 53)
        sums = np.cumsum(d)
        at = int(np.searchsorted(sums, u * sums[-1], "right")) if sums[-1] > 0 else len(chosen)
        chosen.append(min(at, len(v) - 1))
        d = np.minimum(d, ((v - v[chosen[-1]]) ** 2).sum(1))
    return v[chosen]


def _sums(x: DataFrame, runs: list[Run], dim: int, k: int) -> list[tuple[list[np.ndarray], list[float]]]:
    """Of every run and start: per centre the number and sum of its rows, and the cost; one pass for all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[np.zeros((k, 2 + dim)) for _ in r.centres] for r in runs]
        for b in batches:
            every, ids = _matrix(b.column("v"), dim), b.column("id").to_numpy()
            for r, sums in zip(runs, got, strict=True):
                v = every[r.sees(ids)] if r.share < 1 else every
                for c, s in zip(r.centres, sums, strict=True):
                    at, d = nearest(v, c)
                    n = len(c)
                    s[:n, 0] += np.bincount(at, minlength=n)
                    s[:n, 1] += np.bincount(at, d, minlength=n)
                    np.add.at(s[:, 2:], at, v)
        rows = [(i, s, j, row.tolist()) for i, sums in enumerate(got) for s, m in enumerate(sums) for j, row in enumerate(m)]
        columns = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns[:3]), pa.array(columns[3], pa.list_(pa.float64()))], names=["i", "s", "j", "x"])

    parts = x.mapInArrow(run, "i int, s int, j int, x array<double>")
    added = parts.groupBy("i", "s", "j").agg(F.array(*(F.sum(F.col("x")[p]) for p in range(2 + dim))).alias("x"))
    out = [[np.zeros((k, 2 + dim)) for _ in r.centres] for r in runs]
    for r in added.collect():  # the centres
        out[r.i][r.s][r.j] = r.x
    return out


def fit(df: DataFrame, key: str, vector: str, k: int, runs: list[Run], batch: int = 4096, rounds: int = 30) -> tuple[list[tuple[np.ndarray, float]], DataFrame]:
    """Centres and cost of the best start of every run (the first of equals), and ``(id, v)`` of the rows.

    ``batch`` is about how many rows a round reads, ``rounds`` how many rounds there are.
    """
    x, n, dim = vectors(df, key, vector)
    x = x.select(F.col("id").cast("long").alias("id"), "v")
    if not n:
        return [(np.zeros((0, dim)), 0.0) for _ in runs], x
    batches = max(1, -(-n // batch))
    path = new_folder(df.sparkSession, "batches")
    dealt = x.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int"))
    dealt.repartition("batch").write.partitionBy("batch").parquet(path)
    dealt = df.sparkSession.read.schema(dealt.schema).parquet(path)
    taken = x.orderBy(F.xxhash64("id"), "id").limit(OVER * k * max(1, max(r.starts for r in runs))).collect()  # a bounded number
    ids, v = np.array([r.id for r in taken], np.int64), np.array([r.v for r in taken], np.float64).reshape(len(taken), dim)
    for r in runs:
        # every start draws from its own part of the oversample
        r.centres = [seeded(ids[s :: r.starts], v[s :: r.starts], k, r.seed * 1000 + s) for s in range(r.starts) if len(ids[s :: r.starts])]
        r.counts = [np.zeros(len(c)) for c in r.centres]
    for turn in range(rounds if batches > 1 else min(rounds, 10)):
        part = dealt.where(F.col("batch") == turn % batches).select("id", "v")
        for r, sums in zip(runs, _sums(part, runs, dim, k), strict=True):
            for c, count, s in zip(r.centres, r.counts, sums, strict=True):
                got = s[: len(c), 0]
                count += got
                hit = got > 0
                c[hit] += (s[: len(c)][hit, 2:] - got[hit, None] * c[hit]) / count[hit, None]
    out = []
    for r, sums in zip(runs, _sums(dealt.select("id", "v"), runs, dim, k), strict=True):
        costs = [float(s[:, 1].sum()) for s in sums]
        best = min(range(len(costs)), key=lambda i: (costs[i], i))
        out.append((r.centres[best], costs[best]))
    return out, dealt.select("id", "v")


def labelled(x: DataFrame, fits: list[tuple[np.ndarray, float]]) -> DataFrame:
    """``(id, run, label)``: the nearest centre of every row in every run, in one pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (c, _) in enumerate(fits):
                if len(c) and b.num_rows:
                    at, _ = nearest(_matrix(b.column("v"), c.shape[1]), c)
                    yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.full(len(at), i), pa.int32()), pa.array(at.astype(np.int64))], names=["id", "run", "label"])

    return x.mapInArrow(run, "id long, run int, label long")

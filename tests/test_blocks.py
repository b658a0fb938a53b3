"""All vectors against all others, held to plain loops over a small table."""

import collections

import numpy as np
import pytest

from geoaudit.operators import blocks, cluster, pivots
from geoaudit.plans import clusters


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    r = np.random.default_rng(4)
    x = (r.standard_normal((700, 6)) + r.integers(0, 3, 700)[:, None]).astype(np.float32).astype(np.float64)
    x[40:60] = x[40]  # copies
    lab = r.integers(0, 4, 700)
    lab[699] = 9  # alone in its cluster
    path = str(tmp_path_factory.mktemp("vectors"))
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, lab, strict=True))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path, x, lab, ((x[:, None] - x[None]) ** 2).sum(2)


def test_silhouette_of_all_vectors(spark, vectors, monkeypatch):
    monkeypatch.setattr(blocks, "CELL", 150)
    path, _, lab, d = vectors
    d, s = np.sqrt(d), []
    for i in range(len(lab)):
        own = (lab == lab[i]) & (np.arange(len(lab)) != i)
        a, b = d[i, own].mean() if own.any() else None, min(d[i, lab == k].mean() for k in set(lab) - {lab[i]})
        s.append(0 if a is None else (b - a) / max(a, b))
    got = clusters.silhouette(spark, path).first()
    assert got.n == 700 and got.silhouette == pytest.approx(np.mean(s), abs=2e-5)


def test_nearest_label_of_all_vectors(spark, vectors, monkeypatch):
    monkeypatch.setattr(pivots, "CELL", 40)
    monkeypatch.setattr(pivots, "PACK", 150)
    path, _, lab, d = vectors
    want = {}
    for i in range(len(lab)):
        near = sorted((round(d[i, j], 12), j) for j in range(len(lab)) if j != i)[:5]
        n = collections.Counter(int(lab[j]) for _, j in near)
        want[i] = min(k for k in n if n[k] == max(n.values()))
    assert {r.vec_id: r.label for r in clusters.nearest(spark, path).collect()} == want


def test_unlabelled_points_are_asked(spark):
    known = spark.createDataFrame([(1, [0.0], 5), (2, [1.0], 5), (3, [9.0], 7)], "k long, v array<double>, l long")
    asked = spark.createDataFrame([(8, [0.4])], "k long, v array<double>")
    assert cluster.nearest_label(asked, known, 2, "k", "v", "l").collect()[0][:] == (8, 5)

"""Neighbours by pivots against all distances."""

import numpy as np
import pytest

from geoaudit.operators import pivots


def table(spark, x, **more):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>")


def nearest(x, k):
    d = np.round(((x[:, None] - x[None]) ** 2).sum(2), 12)
    return {(i, j, d[i, j], r + 1) for i in range(len(x)) for r, j in enumerate(sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[i, j], j))[:k])}


@pytest.mark.parametrize("cell", [16, 64])
def test_neighbours_are_the_nearest(spark, monkeypatch, cell):
    monkeypatch.setattr(pivots, "CELL", cell)
    monkeypatch.setattr(pivots, "PACK", 4 * cell)
    monkeypatch.setattr(pivots, "SHEET", 8)
    r = np.random.default_rng(2)
    x = r.standard_normal((600, 3)) + 20 * r.integers(0, 4, 600)[:, None]
    x[100:180] = x[100]  # a crowd of copies
    x[200:205] *= 1e6
    found = {tuple(t) for t in pivots.knn(pivots.build(table(spark, x)), 4).collect()}
    assert found == nearest(x, 4)


def test_cells_that_are_proven_far_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(pivots, "CELL", 32)
    monkeypatch.setattr(pivots, "PACK", 64)
    r = np.random.default_rng(3)
    pairs = []
    for n in (1000, 4000):
        x = r.standard_normal((n, 2)) * 0.1 + np.repeat(np.arange(n // 50), 50)[:, None] * [100.0, 7.0]
        cells = pivots.build(table(spark, x))
        reach = cells.table.selectExpr("*", "1.0D AS reach")
        pairs.append(pivots.needed(reach, cells.table).count())
    assert pairs[1] < 8 * max(pairs[0], 40)  # all pairs would be 16 times as many


def test_odd_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [5.0]), (4, [6.0]), (5, None), (None, [0.0, 0.0]), (6, [None, 1.0]), (7, []), (8, [])]
    got = pivots.knn(pivots.build(spark.createDataFrame(rows, "id long, v array<double>")), 3).collect()
    assert {(r.i, r.j, r.d) for r in got} == {(1, 2, 1.0), (2, 1, 1.0), (3, 4, 1.0), (4, 3, 1.0), (7, 8, 0.0), (8, 7, 0.0)}
    assert pivots.knn(pivots.build(spark.createDataFrame([], "id long, v array<double>")), 3).count() == 0

"""Queries over whole tables, held to plain counts over all rows."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoaudit.operators import composite, variogram
from geoaudit.plans import grids
from geoaudit.session import table
from geoaudit.sources import views

SF = "/root/testdata/sf0.001"


def test_variogram_takes_every_cell(spark):
    x = views.cells(spark, SF).select("r", "c", "q").toPandas()
    r, c, q = (x[k].to_numpy() for k in ("r", "c", "q"))
    i, j = np.triu_indices(len(x), 1)
    d, g = np.sqrt((r[i] - r[j]) ** 2.0 + (c[i] - c[j]) ** 2.0), 0.5 * (q[i] - q[j]) ** 2
    k = np.searchsorted(grids.EDGES, d, side="right")
    want = {b: (int((k == b).sum()), float(d[k == b].mean()), float(g[k == b].mean())) for b in range(1, 5)}
    got = {b.bin: b for b in grids.variogram_bins(spark, SF).collect()}
    assert set(got) == set(want)
    for b, (n, lag, gamma) in want.items():
        assert got[b].n == n and got[b].lag == pytest.approx(lag, abs=1e-5) and got[b].gamma == pytest.approx(gamma, abs=1e-5)
    bins = spark.createDataFrame([(b, *w) for b, w in want.items()], "bin long, n long, lag double, gamma double")
    fit = variogram.fit(bins, [2.0, 3.0, 4.0, 5.0, 6.0]).first()
    made = grids.variogram_fit(spark, SF).first()
    assert made.reach == fit.reach and made.nugget == pytest.approx(fit.nugget, abs=1e-3) and made.sill == pytest.approx(fit.sill, abs=1e-3)


def test_one_hot_takes_every_order(spark):
    want = collections.Counter("rare" if r.id % 50 == 0 else r.type for r in views.inventory(spark, SF).collect())
    assert {r.kind: r.n for r in grids.one_hot(spark, SF).collect()} == dict(want)
    assert sum(want.values()) == table(spark, SF, "orders").count()


def ntile(ids, k):
    return {b: [int(i) for i in p] for b, p in enumerate(np.array_split(sorted(ids), k)) if len(p)}


def test_scene_batches_of_every_tile(spark):
    tiles = collections.defaultdict(list)
    for r in views.scenes(spark, SF).collect():
        tiles[r.tile].append(r.scene_id)
    want = {(t, b): (len(p), p[0], p[-1]) for t, ids in tiles.items() for b, p in ntile(ids, 7).items()}
    assert len(tiles) > 1 and {(r.tile, r.batch): (r.n, r.first_scene, r.last_scene) for r in grids.scene_batches(spark, SF).collect()} == want


def test_batches_of_few_rows_and_null_groups(spark):
    x = spark.range(1003).select("id", F.when(F.col("id") >= 3, F.lit("a")).alias("g"))
    got = collections.defaultdict(lambda: collections.defaultdict(list))
    for r in composite.batches(x, 7, "id", ["g"]).orderBy("id").collect():
        got[r.g][r.batch].append(r.id)
    assert got == {None: ntile(range(3), 7), "a": ntile(range(3, 1003), 7)}
    sizes = collections.Counter(r.batch for r in composite.batches(x, 7, "id").collect())
    assert sizes == {b: len(p) for b, p in ntile(range(1003), 7).items()}

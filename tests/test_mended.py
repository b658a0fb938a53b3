"""Results that used to be wrong, and the drift variogram against plain least squares."""

import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoaudit.functions import ranking
from geoaudit.operators import encoder, grid, variogram
from geoaudit.session import new_folder
from geoaudit.sources import reports


def test_composites_are_cut_off(spark):
    path = new_folder(spark, "composite")
    means = spark.createDataFrame([(0, 1, 1, 1.5), (0, 1, 2, 2.99), (0, 1, 3, 70000.7), (0, 1, 4, None), (0, 2, 1, -3.0)], "tile long, cell long, band int, mean double")
    reports.write_composite(means, path, [1, 2, 3, 4])
    rows = spark.read.parquet(path).orderBy("cell").select("b01", "b02", "b03", "b04").collect()
    assert [tuple(r) for r in rows] == [(1, 2, 65535, 0), (0, 0, 0, 0)]


def test_whole_rows_with_a_blank_end_are_kept(spark, tmp_path):
    (tmp_path / "i.csv").write_text("id,type,trigger,year,lat,lon\na,slide,rain,2015.0,1.5,2.5\nb,slide,,x,1.5,\nc,fall\nd,fall,quake,2001,-1,7\n")
    whole = reports.read_inventory(spark, str(tmp_path / "i.csv")).orderBy("id").collect()
    assert [(r.id, r.trigger_kind, r.yr, r.lat, r.lon) for r in whole] == [("a", "rain", 2015, 1.5, 2.5), ("b", "?", None, 1.5, None), ("c", "?", None, None, None), ("d", "quake", 2001, -1.0, 7.0)]
    assert [r.id for r in reports.read_inventory(spark, str(tmp_path / "i.csv"), "drop").orderBy("id").collect()] == ["a", "b", "d"]


def test_empty_fifths_have_a_row(spark):
    areas = spark.createDataFrame([(1.0,)] * 50 + [(2.0,)] * 30 + [(3.0,)] * 20, "s double")
    events = spark.createDataFrame([(1.0,), (3.0,)], "s double")
    rows = ranking.quintile_table(areas, events, "s", 1.0).orderBy("class").collect()
    assert [r["class"] for r in rows] == [1, 2, 3, 4, 5]
    assert [r.n_area for r in rows] == [50, 0, 30, 0, 20]
    assert [r.density_ratio for r in rows] == [1.0, None, 0.0, None, 2.5] and rows[1].per_100_km2 is None


def test_null_groups_stay(spark):
    rows = [(g, s, y) for g in (None, "a") for s, y in ((1.0, 0), (2.0, 1), (3.0, 0), (4.0, 1))]
    x = spark.createDataFrame(rows, "g string, s double, y int")
    got = {r.g: r.auc for r in ranking.rank_metrics(x, "s", "y", ["g"]).collect()}
    assert got == {None: 0.75, "a": 0.75}
    kept = {r.g: r.q50 for r in ranking.order_statistic(x, "s", [0.5], ["g"]).collect()}
    assert kept == {None: 2.0, "a": 2.0}
    caught = ranking.captures(x, x.where("y = 1"), "s", [0.5], ["g"]).collect()
    assert {r.g for r in caught} == {None, "a"}


def test_quantiles_between_values(spark):
    r = np.random.default_rng(9)
    for n in (1, 2, 7, 1000):
        x = np.round(r.normal(0, 3, n), 1)
        df = spark.createDataFrame([(float(v), "g") for v in x] + [(None, "g"), (float("nan"), None)], "v double, g string")
        for p in (0.0, 0.05, 0.5, 0.99, 1.0):
            assert ranking.quantile(df, "v", p, "q").first().q == pytest.approx(np.quantile(x, p), abs=1e-12)
    assert ranking.quantile(df.where("v > 1e9 AND NOT isnan(v)"), "v", 0.5, "q").collect() == [(None,)]
    assert [tuple(q) for q in ranking.quantile(df, "v", 0.5, "q", ["g"]).collect()] == [("g", pytest.approx(np.median(x)))]


def test_wide_windows_of_bands_are_not_mixed_up(spark):
    cells = spark.createDataFrame([(r, c, float(r * 10000 + c)) for r, c in ((0, 0), (1, -600), (0, 400), (-1, 399))], "r int, c int, v double")
    point = spark.createDataFrame([(7, 0, 0)], "id long, r int, c int")
    patch = encoder.band_patches(point, cells, ["v"], 601, "id").first().patch
    at = lambda r, c: patch[(r + 601) * 1202 + c + 601]
    assert (at(0, 0), at(1, -600), at(0, 400), at(-1, 399)) == (0.0, 9400.0, 400.0, -9601.0)
    assert sum(x != 0 for x in patch) == 3


def plain_drift(lags, gamma, n, reaches):
    best = None
    for a in reaches:
        x = np.stack([np.ones_like(lags), np.where(lags >= a, 1.0, 1.5 * lags / a - 0.5 * (lags / a) ** 3), lags], 1) * np.sqrt(n)[:, None]
        y = gamma * np.sqrt(n)
        for k in (3, 2, 1):
            for some in itertools.combinations(range(3), k):
                c = np.zeros(3)
                c[list(some)] = np.linalg.lstsq(x[:, some], y, rcond=None)[0]
                sse = ((x @ c - y) ** 2).sum()
                if (c >= -1e-12).all() and (best is None or sse < best[0] - 1e-9):
                    best = (sse, a, c)
    return best


@pytest.mark.parametrize("truth", [(0.2, 0.6, 0.03, 3.0), (0.0, 1.0, 0.0, 6.0), (0.5, 0.0, 0.1, 4.0), (0.3, 0.4, 0.0, 2.0)])
def test_drift_fit_is_least_squares(spark, truth):
    nugget, sill, drift, reach = truth
    r = np.random.default_rng(1)
    lags = np.arange(1, 11) + 0.1
    shape = np.where(lags >= reach, 1.0, 1.5 * lags / reach - 0.5 * (lags / reach) ** 3)
    gamma = np.maximum(nugget + sill * shape + drift * lags + r.normal(0, 0.01, 10), 0)
    n = r.integers(50, 500, 10)
    reaches = [1.5 + 0.5 * i for i in range(18)]
    bins = spark.createDataFrame([("x", int(k), float(h), float(g)) for k, h, g in zip(n, lags, gamma, strict=True)], "layer string, n long, lag double, gamma double")
    got = variogram.fit_drift(bins, reaches, 10.5, ["layer"]).first()
    sse, a, c = plain_drift(lags, gamma, n, reaches)
    assert got.reach == a and got.sse == pytest.approx(sse, abs=1e-6)
    assert (got.nugget, got.sill, got.drift) == pytest.approx(np.maximum(c, 0), abs=1e-6)
    share = c[1] / (c[0] + c[1] + c[2] * a)
    assert got.share == pytest.approx(share, abs=1e-6) and got.resolved == (share >= 0.1 and a < 0.9 * 10.5)


def test_local_ranges_of_resolved_layers(spark):
    fits = spark.createDataFrame([("a", 2.0, True), ("b", 4.0, True), ("c", 9.0, False), ("d", 5.0, True)], "layer string, reach double, resolved boolean")
    assert tuple(variogram.local_ranges(fits).first()) == (4, 3, 4.0, 3.0, 4.5)
    none = variogram.local_ranges(fits.where(F.col("layer") == "c")).first()
    assert tuple(none) == (1, 0, None, None, None)


def test_rejection_with_replacement(spark):
    cells = spark.createDataFrame([(1, 1), (1, 2), (4, 4), (0, 0)], "r int, c int")
    got = [tuple(r) for r in grid.accepted(cells, 20, 3, 6, 7, 1).orderBy("attempt").collect()]
    tries = []
    for i in range(400 * 20):
        h = hashlib.md5(f"3:{i}".encode()).hexdigest()
        tries.append((i, 1 + int(h[:8], 16) % 4, 1 + int(h[8:16], 16) % 5))
    want = [t for t in tries if t[1:] in {(1, 1), (1, 2), (4, 4)}][:20]
    assert got == want and len({t[1:] for t in got}) == 3
    with pytest.raises(ValueError, match="0 of 5"):
        grid.accepted(cells.where("r = 0"), 5, 3, 6, 7, 1, strict=True)

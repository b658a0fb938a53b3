"""The report layer by hand, and its operators against plain code."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoaudit.functions import folds, inference, ranking
from geoaudit.operators import cluster, encoder, grid, reporttables, variogram
from geoaudit.session import new_folder
from geoaudit.sources import reports


def fold_rows(spark, values):
    return spark.createDataFrame([("b", "R1", m, i, v, v / 2) for m, vs in values.items() for i, v in enumerate(vs)], "basin string, rung string, model string, fold long, roc double, pr double")


def test_tables_by_hand(spark):
    x = fold_rows(spark, {"A": [0.5, 0.5, 0.5, 0.5, 0.5], "TM": [0.6, 0.7, 0.8, 0.9, 1.0], "TM_RAND": [0.6, 0.6, 0.6, 0.6, 0.6], "L0": [0.7] * 5, "L1": [0.9] * 5, "L2": [0.8] * 5})
    r = reporttables.control_table(x, [("d", "R1", "A")], ["TM"]).first()
    assert (r.k, round(r["mean"], 9)) == (5, 0.3) and r.t_high - r["mean"] == pytest.approx(0.1963243, abs=1e-6) and r.nb_sig and r.t_sig
    ladder = reporttables.fold_ladder(x, ["R1", "R2"], ["TM"], "A").first()
    assert ladder.r1_mean == pytest.approx(0.3) and ladder.r1_sig and ladder.r2_mean is None
    s = reporttables.significant_cells(x, ["TM"], "A").first()
    assert (s.cells, s.significant, s.negative) == (1, 1, 0)
    assert reporttables.gap(x, [("TM", "TM_RAND")]).first()["mean"] == pytest.approx(0.2)
    layers = spark.createDataFrame([(f"L{i}", i) for i in range(3)], "model string, layer long")
    w = reporttables.layer_sweep(x, layers, "A").first()
    assert (w.best_layer, round(w.last_delta, 9), round(w.gain, 9)) == (1, 0.3, 0.1)
    b = reporttables.best_pipeline(x, ["TM", "L1"], "A").first()
    assert b.pipeline == "L1" and b["mean"] == pytest.approx(0.4)
    again = fold_rows(spark, {"A": [0.5, 0.5, 0.51], "TM": [0.6]})
    got = {r.model: (r.folds, round(r.most, 9)) for r in reporttables.reproduction(x, again, ["model"]).collect()}
    assert got == {"A": (3, 0.01), "TM": (1, 0.0)}
    m = spark.createDataFrame([(1, "x", 0.25), (1, "x", 0.25), (1, "y", 0.5), (2, "y", 1.0)], "component int, basin string, share double")
    assert [tuple(r) for r in reporttables.share_matrix(m, ["x", "y"]).collect()] == [(1, 2, "x,y", 0.5, 0.5), (2, 1, "y", 0.0, 1.0)]
    c = reporttables.matched_summary(spark.createDataFrame([(0.9,), (0.6,), (0.2,)], "cos double")).first()
    assert (c.n, c.median, round(c.ge_08, 6), round(c.ge_05, 6)) == (3, 0.6, 0.333333, 0.666667)
    assert reporttables.control_table(x.where("false"), [("d", "R1", "A")], ["TM"]).count() == 0


def test_t_quantiles(spark):
    d = spark.createDataFrame([(1,), (30,), (31,), (100,), (999,), (0,)], "d int")
    got = [r.t for r in d.select(inference.t975(F.col("d")).alias("t")).collect()]
    assert got[:5] == pytest.approx([12.7062047364, 2.0422724563, 2.0395134464, 1.9839715185, 1.9623414611], abs=1e-8) and got[5] is None


def test_matching_is_the_best_of_all():
    random.seed(4)
    for k in (1, 2, 4, 6):
        score = np.array([[random.choice([0.1, 0.5, random.random()]) for _ in range(k)] for _ in range(k)])
        best = max(itertools.permutations(range(k)), key=lambda w: (round(sum(score[i, j] for i, j in enumerate(w)), 9), [-j for j in w]))
        assert tuple(cluster.best_way(score)) == best
    big = np.random.default_rng(1).random((10, 10))
    assert sorted(cluster.best_way(big)) == list(range(10))


def test_factorials_and_information(spark):
    d = spark.createDataFrame([(k,) for k in (0, 1, 5, 15, 16, 50, 1000, 10**6)], "k long")
    assert [r.f for r in d.select(cluster.log_factorial(F.col("k")).alias("f")).collect()] == pytest.approx([math.lgamma(k + 1) for k in (0, 1, 5, 15, 16, 50, 1000, 10**6)], rel=1e-13, abs=1e-12)
    random.seed(6)
    a, b = [random.randint(0, 2) for _ in range(9000)], [random.randint(0, 1) for _ in range(9000)]
    x = spark.createDataFrame(list(zip(a, b, strict=True)), "a int, b int")
    n, want, lg = 9000, 0.0, math.lgamma
    for i in range(3):
        for j in range(2):
            p, q = a.count(i), b.count(j)
            for m in range(max(1, p + q - n), min(p, q) + 1):
                want += m / n * math.log(m * n / p / q) * math.exp(lg(p + 1) + lg(q + 1) + lg(n - p + 1) + lg(n - q + 1) - lg(n + 1) - lg(m + 1) - lg(p - m + 1) - lg(q - m + 1) - lg(n - p - q + m + 1))
    assert cluster.expected_information(x, "a", "b").first().emi == pytest.approx(want, rel=1e-6)


def test_captures_are_the_curve(spark):
    random.seed(7)
    area, events = [round(random.random(), 2) for _ in range(300)], [round(random.random() ** 0.5, 2) for _ in range(40)]
    shares = [k / 20 for k in range(21)]
    srt = sorted(area)
    want = {s: 0.0 if s == 0 else 1.0 if s == 1 else sum(e >= srt[math.floor((1 - s) * 299)] for e in events) / 40 for s in shares}
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "s double")
    got = {r.share: r.captured for r in ranking.captures(frame(area), frame(events), "s", shares).collect()}
    assert got == pytest.approx(want)


def test_numbered_and_weights(spark):
    x = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    assert all(r.k == r.i for r in ranking.numbered(x, "k", "i").collect())
    w = inference.bootstrap_weights(spark, 3, 42, 50).groupBy("draw").agg(F.sum("w").alias("n")).collect()
    assert [r.n for r in w] == [50] * 3


def test_folds_travel_with_their_points(spark):
    x = spark.range(50).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("grp"))
    f = x.join(folds.group_folds(x.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), 3), "grp").select("doc_id", "fold")
    path = new_folder(spark, "folds")
    reports.export_folds(f, path, "doc_id")
    assert reports.import_folds(spark, path, x, "doc_id").count() == 50
    with pytest.raises(ValueError, match="other points"):
        reports.import_folds(spark, path, x.where("doc_id <> 3"), "doc_id")


def snyder(lat, lon, meridian):
    """The older series of the same projection, good to millimetres near the meridian."""
    a, f = grid.AXIS, grid.FLATTENING
    e = f * (2 - f)
    p, e1 = math.radians(lat), e / (1 - e)
    n, t, c, w = a / math.sqrt(1 - e * math.sin(p) ** 2), math.tan(p) ** 2, e1 * math.cos(p) ** 2, math.radians(lon - meridian) * math.cos(p)
    m = a * ((1 - e / 4 - 3 * e**2 / 64 - 5 * e**3 / 256) * p - (3 * e / 8 + 3 * e**2 / 32 + 45 * e**3 / 1024) * math.sin(2 * p) + (15 * e**2 / 256 + 45 * e**3 / 1024) * math.sin(4 * p) - 35 * e**3 / 3072 * math.sin(6 * p))
    east = 0.9996 * n * (w + (1 - t + c) * w**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * e1) * w**5 / 120) + 500000
    north = 0.9996 * (m + n * math.tan(p) * (w**2 / 2 + (5 - t + 9 * c + 4 * c**2) * w**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * e1) * w**6 / 720))
    return east, north + 10_000_000


def test_projection(spark):
    places = [(-36.0, -72.0), (-33.4, -70.2), (-20.0, -69.0), (-50.0, -71.0)]
    e, n = grid.transverse_mercator(F.col("lat"), F.col("lon"), -69.0, south=True)
    got = spark.createDataFrame(places, "lat double, lon double").select(e.alias("e"), n.alias("n")).collect()
    for (lat, lon), r in zip(places, got, strict=True):
        assert (r.e, r.n) == pytest.approx(snyder(lat, lon, -69.0), abs=0.01)


def test_grid_sampling_and_lookup(spark):
    cells = grid.full_grid(spark, 6, 7).withColumn("q", F.col("r") * 1.0)
    holes = spark.createDataFrame([(0, 0), (0, 1), (5, 6)], "r long, c long")
    got = {(r.r, r.c): (r.holes, r.area) for r in grid.hole_counts(cells, holes, 1, 6, 7).collect()}
    assert got[0, 0] == (2, 4) and got[1, 1] == (2, 9) and got[3, 3] == (0, 9) and got[5, 6] == (1, 4)
    kept = grid.sample_complete(cells, spark.createDataFrame([(3, 3)], "r long, c long"), holes, 1, 0.95, 100, 1, 6, 7).collect()
    assert {(r.r, r.c) for r in kept} == {(r, c) for r in range(1, 5) for c in range(1, 6)} - {(1, 1), (1, 2), (4, 5)}
    d = grid.draws(cells, ["r", "c"], 5, [1, 2]).collect()
    assert len(d) == 10 and len({(r.draw, r.r, r.c) for r in d}) == 10
    asked = spark.createDataFrame([(0, 0), (9, 9)], "r long, c long")
    assert {r.r: r.valid for r in grid.lookup(asked, cells, ["r", "c"], ["q"]).collect()} == {0: True, 9: False}
    s = grid.scatter(cells.where("r > 3"), "q", 6, 7, -1.0)
    assert s.where("q = -1").count() == 28 and s.count() == 42


def test_pairwise_agreement(spark):
    random.seed(8)
    rows = [(i, run, random.randint(0, 2) if run < 2 else i % 3) for i in range(200) for run in range(4)]
    x = spark.createDataFrame(rows, "id long, run int, label int")
    got = {(r.i, r.j): r.ari for r in cluster.pairwise_agreement(x, ["id"], "run", "label").collect()}
    assert len(got) == 6 and got[2, 3] == pytest.approx(1)
    wide = x.groupBy("id").pivot("run").agg(F.first("label"))
    assert got[0, 2] == pytest.approx(cluster.agreement(wide, "0", "2").first().ari)


def test_nested_fit_recovers_the_model(spark):
    t = lambda h, a: 1.0 if h >= a else 1.5 * h / a - 0.5 * (h / a) ** 3
    rows = [(k, 100, h, 0.2 + 1.5 * t(h, 3.0) + 2.0 * t(h, 9.0)) for k, h in enumerate(np.linspace(0.5, 12, 16).tolist())]
    bins = spark.createDataFrame(rows, "bin long, n long, lag double, gamma double")
    r = variogram.fit_nested(bins, [2.0, 3.0, 5.0, 7.0, 9.0]).first()
    assert (r.short, r.long) == (3.0, 9.0) and [r.nugget, r.sill_short, r.sill_long] == pytest.approx([0.2, 1.5, 2.0], abs=1e-6)


def test_short_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,type,trigger,year,lat,lon\n1,"flow, debris",rain,2010.0,1,2\n2,slide,rain\n3,slide,,2015,1,2\n')
    assert {r.id for r in reports.read_inventory(spark, str(tmp_path / "a.csv")).collect()} == {"1", "2", "3"}
    assert {r.id for r in reports.read_inventory(spark, str(tmp_path / "a.csv"), "drop").collect()} == {"1", "3"}


def test_patches_of_bands_and_rescaling(spark):
    cells = grid.full_grid(spark, 5, 5).withColumn("q", (F.col("r") * 5 + F.col("c")).cast("double")).withColumn("v", F.lit(1.0))
    p = spark.createDataFrame([(7, 0, 0), (8, 2, 2)], "id long, r long, c long")
    got = {(r.id, r.band): r.patch for r in encoder.band_patches(p, cells, ["q", "v"], 1, "id", 2.0).collect()}
    assert got[8, "q"] == [3.0, 3.5, 5.5, 6.0] and got[7, "v"] == [0.0, 0.0, 0.0, 0.5]
    one = {r.id: r.patch for r in encoder.window_patches(p, cells, "q", 1, "id").collect()}
    assert [v / 2 for v in one[8]] == got[8, "q"]
    assert grid.rescaled((30.0, 100.0, -30.0, 900.0), 8) == (240.0, 100.0, -240.0, 900.0)
    assert grid.decimated(cells, 2).count() == 9


def test_inner_split_share(spark):
    x = folds.inner_split(spark.range(4000), "id", 0.15)
    assert 0.12 < x.where("held").count() / 4000 < 0.18

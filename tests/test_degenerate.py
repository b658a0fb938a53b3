"""Tables on which labellings, matchings and fits degenerate: one class, a class that is missing, equal fits."""

import math

import numpy as np

from geoaudit.operators import cluster, reporttables, variogram
from geoaudit.plans import reporting


def test_quality_of_one_cluster_is_undefined(spark):
    x = spark.createDataFrame([(0, 1.0, 2.0), (0, 2.0, 4.0), (0, 4.0, 1.0)], "k int, a double, b double")
    r = cluster.internal_quality(x, "k", ["a", "b"]).first()
    assert r.davies_bouldin is None and math.isnan(r.calinski_harabasz)
    assert cluster.internal_quality(x, "k", ["a", "b"], single=math.inf).first().calinski_harabasz == math.inf
    assert math.isnan(cluster.internal_quality(x.limit(1), "k", ["a", "b"], single=math.inf).first().calinski_harabasz)
    same = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 1.0), (1, 3.0)], "k int, a double")
    r = cluster.internal_quality(same, "k", ["a"]).first()
    assert r.davies_bouldin == math.inf and r.calinski_harabasz == 0


def test_groups_without_a_cluster_have_no_matching(spark):
    rows = [("whole", a, b, float(a == b)) for a in range(2) for b in range(2)] + [("part", 1, b, 1.0) for b in range(2)] + [("one", 1, 1, 1.0)]
    p = spark.createDataFrame(rows, "g string, a int, b int, s double")
    assert {tuple(r) for r in cluster.matched(p, "a", "b", "s", 2, ["g"]).collect()} == {("whole", 0, 0, 1.0), ("whole", 1, 1, 1.0)}
    none = cluster.matched(p.where("g <> 'whole'"), "a", "b", "s", 2, ["g"])
    assert none.collect() == []
    r = reporttables.matched_summary(none, "s").first()
    assert r.n == 0 and r["mean"] is None and r["median"] is None and r.ge_08 is None and r.ge_05 is None


def test_information_of_two_single_classes(spark):
    x = spark.createDataFrame([(1, 1)] * 5, "a int, b int")
    r = cluster.expected_information(x, "a", "b", trivial=math.nan).first()
    assert r.emi == 0 and math.isnan(r.ami)
    assert cluster.expected_information(x, "a", "b").first().ami == 1


def test_buffers_that_leave_no_cell_have_no_row(spark, tmp_path):
    row = (0, 0, 50.0, 1.0, 0.0, 0.0, "R")
    rows = [row, (60, 1, 1.0, 1.0, 0.0, 0.0, "N"), (1, 2, 1.0, 1.0, 0.0, 0.0, "N")]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert {tuple(r) for r in reporting.buffer_sweep(spark, str(tmp_path)).collect()} == {(0, 2), (1, 1)}


def test_agreement_of_two_single_classes(spark):
    x = spark.createDataFrame([(1, 1)] * 4200, "a int, b int")
    r = cluster.agreement(x, "a", "b", trivial=math.nan).first()
    assert r.n == 4200 and math.isnan(r.ari) and math.isnan(r.nmi)
    r = cluster.agreement(x, "a", "b").first()
    assert r.ari == 1 and r.nmi == 1
    r = cluster.agreement(x.limit(1), "a", "b", trivial=math.nan).first()
    assert r.n == 1 and math.isnan(r.ari) and math.isnan(r.nmi)


def test_pairwise_agreement_of_single_classes(spark):
    rows = [(k, run, label) for k in range(6) for run, label in ((0, 5), (1, 5), (2, k % 2))]
    x = spark.createDataFrame(rows, "id int, run int, label int")
    got = {(r.i, r.j): r.ari for r in cluster.pairwise_agreement(x, ["id"], "run", "label", trivial=math.nan).collect()}
    assert math.isnan(got[0, 1]) and got[0, 2] == 0 and got[1, 2] == 0
    assert {(r.i, r.j): r.ari for r in cluster.pairwise_agreement(x, ["id"], "run", "label").collect()}[0, 1] == 1
    single = cluster.pairwise_agreement(x.where("id = 0"), ["id"], "run", "label", trivial=math.nan).collect()
    assert len(single) == 3 and all(math.isnan(r.ari) for r in single)


def test_ranges_that_fit_equally_well_give_the_least(spark):
    # from the last lag on every range spans the same curves, below the second one only the first bin counts
    lags, rows = [1.2, 2.1, 3.0, 4.1, 5.0], []
    for seed in range(12):
        r = np.random.default_rng(seed)
        shape = [1.5 * h / 6 - 0.5 * (h / 6) ** 3 for h in lags]
        rows += [(f"far{seed}", 10**6 + 7 * i, h, 0.3 + 0.5 * s + 0.02 * h) for i, (h, s) in enumerate(zip(lags, shape, strict=True))]
        rows += [(f"near{seed}", 10**6 + 7 * i, h, (0.88 if i == 0 else 0.9) + r.normal(0, 1e-4)) for i, h in enumerate(lags)]
    b = spark.createDataFrame(rows, "layer string, n long, lag double, gamma double")
    got = {x.layer: x.reach for x in variogram.fit_drift(b, [1.5, 1.75, 2.0, 5.0, 5.25, 5.5, 6.0], 5.0, ["layer"]).collect()}
    assert got == {f"far{s}": 5.0 for s in range(12)} | {f"near{s}": 1.5 for s in range(12)}
    # falling semivariances leave the nugget alone, whatever the range
    falling = spark.createDataFrame([(i + 1, 10**6 + 7 * i, h, 0.5 - 0.0317 * h) for i, h in enumerate(lags)], "bin long, n long, lag double, gamma double")
    assert variogram.fit(falling, [2.0, 3.0, 4.0]).first().reach == 2.0


def test_signatures_of_groups_are_scored_by_their_own_moments(spark):
    x = spark.createDataFrame([(g, c, float(g * 10 + c * c)) for g in range(3) for c in range(3)] + [(7, 1, 5.0)], "g int, c int, q double")
    got = {(r.g, r.c): r.q for r in cluster.z_signatures(x, "c", ["q"], ["g"]).collect()}
    for g in (0, 1, 2, 7):
        assert {c: v for (k, c), v in got.items() if k == g} == {r.c: r.q for r in cluster.z_signatures(x.where(f"g = {g}"), "c", ["q"]).collect()}
    assert len(got) == 10

"""Evaluation layer on hand-checkable cases and by properties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geoaudit.functions import features, folds, inference, ranking
from geoaudit.operators import cluster, composite, grid, inventory, variogram
from geoaudit.sources import reports
from geoaudit.session import new_folder


def scored(spark, rows):
    return spark.createDataFrame(rows, "g string, y int, s double")


def test_rank_metrics_with_ties(spark):
    x = scored(spark, [("a", 0, 1.0), ("a", 0, 2.0), ("a", 1, 2.0), ("a", 1, 3.0), ("b", 1, 1.0), ("b", 1, 2.0), ("a", None, 9.0), ("a", 1, None)])
    got = {r.g: r for r in ranking.rank_metrics(x, "s", "y", ["g"]).collect()}
    assert got["a"].auc == pytest.approx(0.875) and got["a"].ap == pytest.approx(0.8333333, abs=1e-6)
    assert got["b"].auc is None and got["b"].ap is None
    assert ranking.rank_metrics(x.where("false"), "s", "y", ["g"]).count() == 0


def test_rank_metrics_properties(spark):
    random.seed(1)
    rows = [("x", random.randint(0, 1), round(random.random(), 2)) for _ in range(500)]
    x = scored(spark, rows)
    a = ranking.rank_metrics(x, "s", "y", ["g"]).first().auc
    b = ranking.rank_metrics(x.withColumn("s", -F.col("s")), "s", "y", ["g"]).first().auc
    c = ranking.rank_metrics(x.withColumn("s", F.exp("s")), "s", "y", ["g"]).first().auc
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    direct = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert a == pytest.approx(direct) and a == pytest.approx(1 - b) and a == pytest.approx(c)


def test_order_statistic(spark):
    x = scored(spark, [("a", 1, float(i)) for i in range(1, 11)])
    assert ranking.order_statistic(x, "s", [0.8], ["g"]).first().q80 == 8.0


def test_group_folds(spark):
    g = spark.createDataFrame([("a", 5), ("b", 4), ("c", 3), ("d", 1)], "grp string, n int")
    assert {r.grp: r.fold for r in folds.group_folds(g, 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 0}
    random.seed(2)
    sizes = {i: random.randint(1, 50) for i in range(60)}
    got = folds.group_folds(spark.createDataFrame(list(sizes.items()), "grp int, n int"), 5).collect()
    loads = [sum(sizes[r.grp] for r in got if r.fold == k) for k in range(5)]
    assert sorted(r.grp for r in got) == sorted(sizes) and max(loads) - min(loads) <= 50


def test_stratified_group_folds(spark):
    random.seed(3)
    rows = [(i, random.randint(0, 9), random.randint(0, 30)) for i in range(60)]
    got = folds.stratified_group_folds(spark.createDataFrame(rows, "grp int, pos int, neg int"), 4).collect()
    fold = {r.grp: r.fold for r in got}
    pos = [sum(p for i, p, _ in rows if fold[i] == k) for k in range(4)]
    assert len(fold) == 60 and max(pos) - min(pos) <= 9


def test_intervals(spark):
    d = spark.createDataFrame([(float(i),) for i in range(1, 6)], "d double")
    r = inference.paired_intervals(d, "d", []).first()
    assert r["mean"] == 3 and r.t_high - 3 == pytest.approx(1.963243, abs=1e-6) and r.nb_high - 3 == pytest.approx(2.944865, abs=1e-6)
    assert r.nb_low < r.t_low and r.t_sig


def test_block_and_pixels(spark):
    one = spark.createDataFrame([(334, 700)], "r int, c int")
    assert one.select(folds.block_id(F.col("r"), F.col("c"), 1000, 333).alias("b")).first().b == 6
    p = spark.createDataFrame([(-0.4, 0.4)], "x double, y double")
    t, f = (grid.world_to_pixel(F.col("x"), F.col("y"), 1.0, 0.0, -1.0, 0.0, m) for m in ("trunc", "floor"))
    assert p.select(t[1].alias("a"), f[1].alias("b")).first()[:] == (0, -1)


def test_exclusion_and_windows(spark):
    cells = grid.full_grid(spark, 11, 11).withColumn("v", (F.col("r") * 3 + F.col("c") % 4).cast("double"))
    kept = {(r.r, r.c) for r in grid.exclude_near(cells, spark.createDataFrame([(5, 5)], "r long, c long"), 1).collect()}
    assert len(kept) == 121 - 9 and (5, 7) in kept and (6, 6) not in kept
    p = spark.createDataFrame([(1, 0, 0), (2, 5, 6)], "id long, r long, c long")
    direct = {r.id: r for r in grid.window_stats(p, cells, 2, ["v"], "id").collect()}
    sums = {(r.r, r.c): r.window_sum for r in grid.window_sums(grid.prefix_sums(cells, "v"), p.select("r", "c"), 2, 11, 11).collect()}
    assert direct[1].n_cells == 9 and sums[0, 0] == pytest.approx(9 * direct[1].v_mean)
    assert sums[5, 6] == pytest.approx(25 * direct[2].v_mean)


def test_composites_agree(spark):
    random.seed(5)
    rows = [(s, b, c, random.choice([None, 900.0, 1500.0, 2222.0])) for s in range(12) for b in range(2) for c in range(5)]
    x = spark.createDataFrame(rows + [(99, 7, 7, None)], "scene_id long, band long, cell long, dn double").withColumn("dn", composite.harmonised(F.col("dn"), F.lit(1000.0)))
    shown = lambda df: {(r.band, r.cell): (r["mean"] if r["mean"] is None else round(r["mean"], 6), r.n) for r in df.collect()}
    whole = shown(composite.mean_composite(x))
    parts = None
    for k in range(3):
        p = composite.partial_sums(x.where(F.col("scene_id") % 3 == k))
        parts = p if parts is None else parts.union(p)
    assert shown(composite.merged(parts)) == whole
    assert whole[7, 7] == (None, 0)
    b = spark.createDataFrame([("04.00",), ("03.01",), ("x",), (None,)], "baseline string")
    assert [r.o for r in b.select(composite.offset_of(F.col("baseline")).alias("o")).collect()] == [1000.0, 0.0, 0.0, 0.0]


def test_features(spark):
    x = spark.createDataFrame([(-1.0, [0.0, 0.0]), (2.0, [900.0, 1500.0])], "x double, b array<double>")
    got = x.select(features.log1p_or_missing(F.col("x")).alias("a"), features.log1p_clipped(F.col("x")).alias("c"), features.nodata_offset(F.col("b")).alias("o"), features.bucket_left(F.col("x"), [2.0, 3.0]).alias("l"), features.bucket_right(F.col("x"), [2.0, 3.0]).alias("r")).collect()
    assert got[0].a is None and got[0].c == 0 and got[0].o == [0, 0] and got[1].o == [-100, 500]
    assert (got[1].l, got[1].r) == (1, 0) and got[1].a == pytest.approx(math.log(3))
    y = spark.createDataFrame([("a", 1), ("b", 1), ("z", 0)], "k string, t int")
    assert {r.k: r.one_hot for r in features.one_hot_fitted(y, F.col("t") == 1, "k").collect()}["z"] == [0.0, 0.0]


def test_agreement(spark):
    random.seed(6)
    x = spark.createDataFrame([(random.randint(0, 3), random.randint(0, 2)) for _ in range(300)], "a int, b int").withColumn("c", F.col("a") * 10)
    r = cluster.agreement(x, "a", "c").first()
    assert r.ari == pytest.approx(1) and r.nmi == pytest.approx(1)
    assert abs(cluster.agreement(x, "a", "b").first().ari) < 0.05
    assert abs(cluster.expected_information(x, "a", "b").first().ami) < 0.05


def test_matching(spark):
    score = [[0.9, 0.8, 0.1], [0.8, 0.1, 0.0], [0.2, 0.3, 0.25]]
    p = spark.createDataFrame([(0, i, j, score[i][j]) for i in range(3) for j in range(3)], "g int, a int, b int, s double")
    assert {(r.a, r.b) for r in cluster.matched(p, "a", "b", "s", 3, ["g"]).collect()} == {(0, 1), (1, 0), (2, 2)}


def test_variogram_fit_recovers_the_model(spark):
    bins = spark.range(1, 12).select(F.col("id").alias("bin"), F.lit(100).alias("n"), F.col("id").cast("double").alias("lag"))
    bins = bins.withColumn("gamma", features.spherical(F.col("lag"), 0.3, 2.0, 7.0))
    r = variogram.fit(bins, [4.0, 5.0, 6.0, 7.0, 8.0]).first()
    assert (r.reach, round(r.nugget, 6), round(r.sill, 6), r.censored) == (7.0, 0.3, 2.0, False)


def test_inventory_reader(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,type,trigger,year,lat,lon\n1,"flow, debris",rain,2010.0,1,2\n2,slide,,x,1,2\n3,slide, ,2015,1,2\n')
    got = {r.id: r for r in reports.read_inventory(spark, str(tmp_path / "a.csv")).collect()}
    assert got["1"].type == "flow, debris" and got["1"].yr == 2010 and got["2"].yr is None and got["3"].trigger_kind == "?"
    x = spark.createDataFrame([("a", 2010), ("a", 2015)], "type string, yr int")
    assert inventory.year_profile(x, ["type"]).first()["median"] == 2015


def test_reports(spark):
    path = new_folder(spark, "reports")
    rows = spark.sql("SELECT 'b' AS basin, array(named_struct('fold', 0, 'roc_A', 0.5D, 'delta_roc', double('NaN'))) AS fold_results")
    reports.write_reports(rows, path)
    r = reports.read_reports(spark, path).first()
    assert r.basin == "b" and r.fold == 0 and r.roc_A == 0.5 and r.pr_B is None


def test_queries_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from geoaudit.plans import registry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("nation", "customer", "orders", "lineitem", "events", "documents", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("group_folds", "class_metrics", "quintile_table", "exclusion", "window_stats", "window_sums", "variogram_bins", "scene_selection", "mean_composite", "contingency", "year_profile"):
        df = registry.QUERIES[name](spark, sf)
        cols = sorted(df.columns)
        key = lambda rows: sorted(repr(tuple(None if v is None else float(v) if isinstance(v, (int, float)) else v for v in r)) for r in rows)
        want = con.sql(f"SELECT {', '.join(f'"{c}"' for c in cols)} FROM ({registry.ORACLE[name]})").fetchall()
        assert key(tuple(r) for r in df.select(*cols).collect()) == key(want), name

"""Queries of the evaluation layer: folds, rank metrics, intervals, rate curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoaudit.functions import folds, inference, ranking
from geoaudit.plans._common import rounded
from geoaudit.sources import views
from geoaudit.sources.views import with_views

K = 5


def _sizes(scored: DataFrame) -> DataFrame:
    return scored.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = views.scored(spark, sf_dir)
    return x.join(folds.group_folds(_sizes(x), K), "grp")


def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents in five folds of even size."""
    return folds.group_folds(_sizes(views.scored(spark, sf_dir)), K)


def stratified_group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents in five folds of even class shares."""
    x = views.scored(spark, sf_dir).groupBy("grp").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    return folds.stratified_group_folds(x, K)


def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each class dealt to five folds: counts by fold and class."""
    x = folds.stratified_folds(views.scored(spark, sf_dir), K, "y", "doc_id")
    return x.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n"))


def fold_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is one score better than another?  Areas per fold, their paired difference, and both intervals."""
    x = _folded(spark, sf_dir).select("fold", "y", F.expr("stack(2, 's', s, 'z', z) AS (name, v)"))
    m = ranking.rank_metrics(x, "v", "y", ["name", "fold"])  # both scores in one pass
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("auc")))
    d = m.groupBy("fold").agg((of("z") - of("s")).alias("delta"))
    return rounded(inference.paired_intervals(d, "delta", []))


def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area and average precision by class."""
    return rounded(ranking.rank_metrics(views.scored(spark, sf_dir), "s", "y", ["cls"]))


def univariate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area and average precision of each score taken as it is, per fold."""
    x = _folded(spark, sf_dir).select("fold", "y", F.expr("stack(2, 's', s, 'z', z) AS (name, v)"))
    return rounded(ranking.rank_metrics(x, "v", "y", ["name", "fold"]))


def fold_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that a rank metric could not score."""
    return folds.single_class_folds(views.scored(spark, sf_dir), "y", "grp")


def fold_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per fold where blocks without a fold take their number modulo five."""
    x = views.scored(spark, sf_dir).withColumn("block", F.col("doc_id") % 23)
    listed = x.where("block < 15").groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    return folds.fold_or_default(x, folds.group_folds(listed, K, "block"), "block").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("n_pos"))


def replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Across ten draws of documents: mean, spread and sign of a class's difference of means."""
    x = views.scored(spark, sf_dir).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(9))))
    x = x.where(F.conv(F.substring(F.md5(F.concat_ws(":", F.col("draw").cast("string"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("bigint") % 3 == 0)
    m = x.groupBy("draw", "cls").agg((F.avg(F.when(F.col("y") == 1, F.col("s"))) - F.avg(F.when(F.col("y") == 0, F.col("s")))).alias("delta"))
    m = m.where("delta IS NOT NULL").withColumn("ref", F.lit(-1.0)).withColumn("sig", F.abs("delta") > 100)
    return rounded(inference.replicate_summary(m, "delta", "ref", "sig", ["cls"]), 4)


def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired bootstrap of the pooled difference of areas, 100 draws."""
    x = views.scored(spark, sf_dir).select("doc_id", "y", "s", "z")
    n = x.count()
    return rounded(inference.bootstrap_delta(ranking.numbered(x, "doc_id", "i"), "s", "z", "y", 100, 42, n))


def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order statistics at floor(p (n - 1)) by class."""
    return ranking.order_statistic(views.scored(spark, sf_dir), "s", [0.1, 0.5, 0.8], ["cls"])


def rate_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate-curve area of events over the area's scores, by class."""
    x = views.scored(spark, sf_dir)
    return rounded(ranking.rate_curve_area(x.where("y = 0"), x.where("y = 1"), "s", ["cls"]))


def quintiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area and events by fifth of the score, with density ratios."""
    x = views.scored(spark, sf_dir)
    return rounded(ranking.quintile_table(x, x.where("y = 0"), "s", 0.25))


def monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether event shares rise over the fifths."""
    x = views.scored(spark, sf_dir)
    t = ranking.quintile_table(x, x.where("y = 0"), "s", 0.25)
    up = F.col("density_ratio") >= F.lag("density_ratio").over(Window.orderBy("class"))
    return t.withColumn("__up", up).agg(F.coalesce(F.bool_and("__up"), F.lit(True)).alias("rising"), F.count(F.lit(1)).alias("classes"))


def block_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and positive blocks for several block sizes and two grid offsets; sizes with too few blocks drop out."""
    x = views.cells(spark, sf_dir).where("e > 0").select("r", "c")
    sizes = spark.createDataFrame([(s, o) for s in (5, 9, 20, 40) for o in (0, 3)], "side int, off int")
    y = x.crossJoin(F.broadcast(sizes))  # eight rows
    across = F.ceil((F.lit(views.WIDTH) + F.col("off")) / F.col("side"))
    block = F.floor((F.col("r") + F.col("off")) / F.col("side")) * across + F.floor((F.col("c") + F.col("off")) / F.col("side"))
    return y.groupBy(F.col("side").cast("bigint").alias("side"), F.col("off").cast("bigint").alias("off")).agg(F.countDistinct(block).alias("blocks"), F.count(F.lit(1)).alias("n")).where(F.col("blocks") >= K)


_FOLDS = """
WITH RECURSIVE sizes AS (SELECT grp, count(*) AS n FROM scored GROUP BY grp),
ordered AS (SELECT grp, n, row_number() OVER (ORDER BY n DESC, grp DESC) AS k FROM sizes),
walk(k, grp, fold, loads) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(-1 AS BIGINT), CAST([0, 0, 0, 0, 0] AS BIGINT[])
  UNION ALL
  SELECT o.k, o.grp, CAST(list_position(w.loads, list_min(w.loads)) - 1 AS BIGINT),
    list_transform(w.loads, lambda x, i: CAST(CASE WHEN i = list_position(w.loads, list_min(w.loads)) THEN x + o.n ELSE x END AS BIGINT))
  FROM walk w JOIN ordered o ON o.k = w.k + 1),
folds AS (SELECT grp, fold FROM walk WHERE k > 0)"""

_AUC = """
  SELECT {by}, {name} sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS n,
    (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc
  FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {s}) + (count(*) OVER (PARTITION BY {by}, {s}) - 1) / 2.0 AS rk FROM {t}) GROUP BY {by}"""

_T4, _ROUND = 2.7764451052, "round({0}, 6) + 0.0 AS {1}"


def _r(*pairs: tuple[str, str], digits: int = 6) -> str:
    return ", ".join(f"round({e}, {digits}) + 0.0 AS {n}" for e, n in pairs)


_AP = """
  SELECT {by}, sum(CASE WHEN p > 0 THEN p * tp / called ELSE 0 END) / nullif(max(pp), 0) AS ap, max(pp) AS pp, max(nn) AS nn FROM (
    SELECT {by}, p, sum(p) OVER w AS tp, sum(p + q) OVER w AS called, sum(p) OVER (PARTITION BY {by}) AS pp, sum(q) OVER (PARTITION BY {by}) AS nn
    FROM (SELECT {by}, {s} AS v, CAST(sum(y) AS DOUBLE) AS p, CAST(sum(1 - y) AS DOUBLE) AS q FROM {t} GROUP BY {by}, {s})
    WINDOW w AS (PARTITION BY {by} ORDER BY v DESC)) GROUP BY {by}"""

QUERIES = {
    "fold_comparison": fold_comparison,
    "group_folds": group_folds,
    "stratified_group_folds": stratified_group_folds,
    "stratified_folds": stratified_folds,
    "class_metrics": class_metrics,
    "univariate_metrics": univariate_metrics,
    "fold_guard": fold_guard,
    "fold_default": fold_default,
    "replicate_summary": replicates,
    "bootstrap_delta": bootstrap,
    "order_statistics": quantiles,
    "rate_curve_area": rate_curve,
    "quintile_table": quintiles,
    "monotone_classes": monotone,
    "block_sweep": block_sweep,
}

_QUINT = """
WITH edges AS (SELECT list_sort(list(s)) AS v, count(*) AS n FROM scored),
e AS (SELECT v[CAST(floor(0.2 * (n - 1)) AS INT) + 1] AS a, v[CAST(floor(0.4 * (n - 1)) AS INT) + 1] AS b, v[CAST(floor(0.6 * (n - 1)) AS INT) + 1] AS c, v[CAST(floor(0.8 * (n - 1)) AS INT) + 1] AS d FROM edges),
x AS (SELECT CAST(1 + (s > a)::INT + (s > b)::INT + (s > c)::INT + (s > d)::INT AS BIGINT) AS class, y FROM scored, e),
g AS (SELECT class, count(y) AS n_area, count(*) FILTER (WHERE y = 0) AS n_events FROM (SELECT CAST(unnest(range(1, 6)) AS BIGINT) AS class) LEFT JOIN x USING (class) GROUP BY class),
t AS (SELECT *, n_area / sum(n_area) OVER () AS area_share, n_events / sum(n_events) OVER () AS event_share FROM g)"""

ORACLE = {
    "group_folds": with_views(_FOLDS + " SELECT grp, fold FROM folds", "scored"),
    "fold_comparison": with_views(
        _FOLDS + ", x AS (SELECT s.*, f.fold FROM scored s JOIN folds f USING (grp)), a AS (" + _AUC.format(by="fold", name="", s="s", t="x") + "), b AS (" + _AUC.format(by="fold", name="", s="z", t="x") + f"""),
        d AS (SELECT b.auc - a.auc AS v FROM a JOIN b USING (fold) WHERE a.auc IS NOT NULL AND b.auc IS NOT NULL),
        m AS (SELECT count(*) AS k, avg(v) AS mean, stddev_samp(v) AS sd, stddev_pop(v) AS sd_pop FROM d),
        h AS (SELECT *, [12.7062047364, 4.3026527297, 3.1824463053, 2.7764451052][k - 1] * sd AS w FROM m)
        SELECT k, {_r(("mean", "mean"), ("sd_pop", "sd_pop"), ("mean - w / sqrt(k)", "t_low"), ("mean + w / sqrt(k)", "t_high"), ("mean - w * sqrt(1 / k + 1 / (k - 1))", "nb_low"), ("mean + w * sqrt(1 / k + 1 / (k - 1))", "nb_high"))},
          NOT (0 BETWEEN mean - w / sqrt(k) AND mean + w / sqrt(k)) AS t_sig, NOT (0 BETWEEN mean - w * sqrt(1 / k + 1 / (k - 1)) AND mean + w * sqrt(1 / k + 1 / (k - 1))) AS nb_sig FROM h WHERE k > 1""",
        "scored",
    ),
    "class_metrics": with_views("WITH a AS (" + _AUC.format(by="cls", name="", s="s", t="scored") + "), b AS (" + _AP.format(by="cls", s="s", t="scored") + ") SELECT cls, CAST(p AS BIGINT) AS n_pos, CAST(n AS BIGINT) AS n_neg, round(auc, 6) + 0.0 AS auc, CASE WHEN nn > 0 THEN round(ap, 6) + 0.0 END AS ap FROM a JOIN b USING (cls)", "scored"),
    "univariate_metrics": with_views(
        _FOLDS + ", x AS (SELECT f.fold, y, 's' AS name, s AS v FROM scored JOIN folds f USING (grp) UNION ALL SELECT f.fold, y, 'z', z FROM scored JOIN folds f USING (grp)), a AS (" + _AUC.format(by="name, fold", name="", s="v", t="x") + "), b AS (" + _AP.format(by="name, fold", s="v", t="x")
        + ") SELECT name, fold, CAST(p AS BIGINT) AS n_pos, CAST(n AS BIGINT) AS n_neg, round(auc, 6) + 0.0 AS auc, CASE WHEN nn > 0 THEN round(ap, 6) + 0.0 END AS ap FROM a JOIN b USING (name, fold)",
        "scored",
    ),
    "stratified_group_folds": with_views(
        """WITH RECURSIVE g AS (SELECT grp, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM scored GROUP BY grp), tot AS (SELECT greatest(sum(pos), 1) AS tp, greatest(sum(neg), 1) AS tq FROM g),
        ordered AS (SELECT g.*, tot.*, row_number() OVER (ORDER BY abs(pos - neg) DESC, grp DESC) AS k FROM g, tot),
        walk(k, grp, fold, p, q) AS (
          SELECT CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(-1 AS BIGINT), CAST([0, 0, 0, 0, 0] AS DOUBLE[]), CAST([0, 0, 0, 0, 0] AS DOUBLE[])
          UNION ALL
          SELECT k, grp, CAST(best - 1 AS BIGINT), list_transform(p, lambda x, j: x + CASE WHEN j = best THEN pos ELSE 0 END), list_transform(q, lambda x, j: x + CASE WHEN j = best THEN neg ELSE 0 END)
          FROM (SELECT o.k, o.grp, o.pos, o.neg, w.p, w.q, list_min(list_transform([1, 2, 3, 4, 5], lambda i: {'c': round((
              list_aggregate(list_transform(w.p, lambda x, j: (x + CASE WHEN j = i THEN o.pos ELSE 0 END) / o.tp), 'stddev_pop') + list_aggregate(list_transform(w.q, lambda x, j: (x + CASE WHEN j = i THEN o.neg ELSE 0 END) / o.tq), 'stddev_pop')) / 2, 9),
              'm': w.p[i] + w.q[i], 'i': i})).i AS best FROM walk w JOIN ordered o ON o.k = w.k + 1))
        SELECT grp, fold FROM walk WHERE k > 0""",
        "scored",
    ),
    "fold_guard": with_views("SELECT grp, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos FROM scored GROUP BY grp HAVING sum(y) = 0 OR sum(y) = count(*)", "scored"),
    "fold_default": with_views(
        _FOLDS.replace("SELECT grp, count(*) AS n FROM scored GROUP BY grp", "SELECT doc_id % 23 AS grp, count(*) AS n FROM scored WHERE doc_id % 23 < 15 GROUP BY 1").replace("CAST(NULL AS VARCHAR)", "CAST(NULL AS BIGINT)")
        + " SELECT CAST(coalesce(f.fold, doc_id % 23 % 5) AS BIGINT) AS fold, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos FROM scored LEFT JOIN folds f ON f.grp = doc_id % 23 GROUP BY 1",
        "scored",
    ),
    "stratified_folds": with_views("WITH h AS (SELECT y, doc_id, md5('42:' || doc_id) AS h FROM scored), x AS (SELECT y, CAST((row_number() OVER (PARTITION BY y ORDER BY h, doc_id) - 1) % 5 AS BIGINT) AS fold FROM h) SELECT fold, y, count(*) AS n FROM x GROUP BY ALL", "scored"),
    "replicate_summary": with_views(
        f"""WITH m AS (SELECT draw, cls, avg(s) FILTER (WHERE y = 1) - avg(s) FILTER (WHERE y = 0) AS delta FROM scored, (SELECT unnest(range(10)) AS draw) WHERE CAST('0x' || substr(md5(draw || ':' || doc_id), 1, 8) AS BIGINT) % 3 = 0 GROUP BY ALL)
        SELECT cls, count(*) AS n, {_r(("avg(delta)", "mean"), ("stddev_samp(delta)", "sd"), ("min(delta)", "least"), ("max(delta)", "most"), digits=4)}, CAST(sum((delta < 0)::INT) AS BIGINT) AS same_sign, CAST(sum((delta < 0 AND abs(delta) > 100)::INT) AS BIGINT) AS sig_same_sign
        FROM m WHERE delta IS NOT NULL GROUP BY cls""",
        "scored",
    ),
    "bootstrap_delta": with_views(
        "WITH p AS (SELECT y, s, z, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM scored), n AS (SELECT count(*) AS n FROM p), d AS (SELECT draw, CAST('0x' || substr(md5('42:' || draw || ':' || place), 1, 12) AS BIGINT) % n AS i FROM (SELECT unnest(range(100)) AS draw), (SELECT unnest(range(n)) AS place, n FROM n)), x AS (SELECT draw, y, s, z FROM d JOIN p USING (i)), a AS ("
        + _AUC.format(by="draw", name="", s="s", t="x") + "), b AS (" + _AUC.format(by="draw", name="", s="z", t="x")
        + f") SELECT count(*) AS draws, {_r(('avg(b.auc - a.auc)', 'mean'), ('quantile_cont(b.auc - a.auc, 0.025)', 'low'), ('quantile_cont(b.auc - a.auc, 0.975)', 'high'))} FROM a JOIN b USING (draw) WHERE a.auc IS NOT NULL",
        "scored",
    ),
    "order_statistics": with_views("WITH g AS (SELECT cls, list_sort(list(s)) AS v, count(*) AS n FROM scored GROUP BY cls) SELECT cls, v[CAST(floor(0.1 * (n - 1)) AS INT) + 1] AS q10, v[CAST(floor(0.5 * (n - 1)) AS INT) + 1] AS q50, v[CAST(floor(0.8 * (n - 1)) AS INT) + 1] AS q80 FROM g", "scored"),
    "rate_curve_area": with_views("WITH a AS (SELECT cls, s FROM scored WHERE y = 0), e AS (SELECT cls, s FROM scored WHERE y = 1), c AS (SELECT e.cls, avg((a.s < e.s)::INT + 0.5 * (a.s = e.s)::INT) AS v FROM e JOIN a USING (cls) GROUP BY e.cls), g AS (SELECT cls, count(*) FILTER (WHERE y = 1) AS n_events, count(*) FILTER (WHERE y = 0) AS n_area FROM scored GROUP BY cls) SELECT cls, n_events, n_area, round(v, 6) + 0.0 AS rate_auc FROM g LEFT JOIN c USING (cls)", "scored"),
    "quintile_table": with_views(_QUINT + f" SELECT class, n_area, n_events, {_r(('area_share', 'area_share'), ('event_share', 'event_share'), ('100 * n_events / nullif(n_area * 0.25, 0)', 'per_100_km2'), ('event_share / nullif(area_share, 0)', 'density_ratio'))} FROM t", "scored"),
    "monotone_classes": with_views(_QUINT + ", u AS (SELECT event_share / nullif(area_share, 0) >= lag(event_share / nullif(area_share, 0)) OVER (ORDER BY class) AS up FROM t) SELECT coalesce(bool_and(up), true) AS rising, count(*) AS classes FROM u", "scored"),
    "block_sweep": with_views("WITH x AS (SELECT r, c, CAST(side AS BIGINT) AS side, CAST(off AS BIGINT) AS off FROM cells, (SELECT unnest([5, 9, 20, 40]) AS side), (SELECT unnest([0, 3]) AS off) WHERE e > 0) SELECT side, off, count(DISTINCT floor((r + off) / side) * ceil((70 + off) / side) + floor((c + off) / side)) AS blocks, count(*) AS n FROM x GROUP BY side, off HAVING count(DISTINCT floor((r + off) / side) * ceil((70 + off) / side) + floor((c + off) / side)) >= 5", "cells"),
}

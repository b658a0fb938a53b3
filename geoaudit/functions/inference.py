"""Paired intervals over folds, replicate summaries and the paired bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoaudit.functions.ranking import level_metrics

#: The 0.975 quantiles of Student's t for 1 to 30 degrees of freedom.
T975 = [
    12.7062047364, 4.3026527299, 3.1824463053, 2.7764451052, 2.5705818356, 2.4469118511, 2.3646242516, 2.3060041352, 2.2621571628, 2.2281388520,
    2.2009851601, 2.1788128297, 2.1603686565, 2.1447866879, 2.1314495456, 2.1199052992, 2.1098155778, 2.1009220402, 2.0930240544, 2.0859634473,
    2.0796138447, 2.0738730679, 2.0686576104, 2.0638985616, 2.0595385528, 2.0555294386, 2.0518305165, 2.0484071418, 2.0452296421, 2.0422724563,
]


def t975(degrees: Column) -> Column:
    """Quantile by degrees of freedom: listed up to 30, beyond by the expansion in 1 / degrees (error below 1e-8)."""
    z = 1.959963984540054
    terms = [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
        (27 * z**11 + 339 * z**9 + 930 * z**7 - 1782 * z**5 - 765 * z**3 + 17955 * z) / 368640,
    ]
    series = F.lit(z)
    for k, t in enumerate(terms, 1):
        series = series + F.lit(t) / F.pow(degrees.cast("double"), k)
    listed = F.array(*(F.lit(x) for x in T975))
    return F.when(degrees.between(1, len(T975)), F.get(listed, degrees.cast("int") - 1)).when(degrees > len(T975), series)


def paired_intervals(deltas: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Per group of fold differences: mean, the t interval, the corrected interval, and their verdicts.

    The corrected variance factor for k folds is 1/k + 1/(k - 1).
    """
    x = deltas.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.stddev_pop(value).alias("sd_pop"))
    half = t975(F.col("k") - 1) * F.col("sd") / F.sqrt("k")
    wide = t975(F.col("k") - 1) * F.col("sd") * F.sqrt(1 / F.col("k") + 1 / (F.col("k") - 1))
    out = lambda h: ~F.lit(0.0).between(F.col("mean") - h, F.col("mean") + h)
    return x.where("k > 1").select(*by, "k", "mean", "sd_pop", (F.col("mean") - half).alias("t_low"), (F.col("mean") + half).alias("t_high"), out(half).alias("t_sig"), (F.col("mean") - wide).alias("nb_low"), (F.col("mean") + wide).alias("nb_high"), out(wide).alias("nb_sig"))


def replicate_summary(replicates: DataFrame, value: str, reference: str, significant: str, by: list[str]) -> DataFrame:
    """Across draws: mean, sd (ddof 1), least, most, how many share the reference's sign, and significantly so."""
    same = F.signum(value) == F.signum(reference)
    return replicates.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"),
        F.sum(same.cast("bigint")).alias("same_sign"), F.sum((same & F.col(significant)).cast("bigint")).alias("sig_same_sign"),
    )


def bootstrap_weights(spark: SparkSession, draws: int, seed: int, n: int) -> DataFrame:
    """``(draw, i, w)``: how often each of n points comes in each of ``draws`` resamples with replacement.

    Place p of draw b takes the point ``md5(seed:b:p) mod n``; points that a draw
    does not take are left out.
    """
    places = spark.range(draws * n).select(F.expr(f"id div {max(n, 1)}").alias("draw"), (F.col("id") % max(n, 1)).alias("place"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("place").cast("string"))), 1, 12), 16, 10).cast("bigint")
    return places.groupBy("draw", (h % max(n, 1)).alias("i")).agg(F.count(F.lit(1)).alias("w"))


def bootstrap_delta(points: DataFrame, a: str, b: str, label: str, draws: int, seed: int, n: int) -> DataFrame:
    """Pooled difference of ROC areas (b - a) with its percentile interval; one-class draws are skipped.

    ``points`` has ``i``, numbered from 0.  A draw is a weight for each point, so both
    scores of all draws are ranked in one pass, by ranges cut once for all draws.
    """
    both = points.select("i", label, F.expr(f"stack(2, 'a', {a}, 'b', {b}) AS (name, score)")).where(F.col("score").isNotNull() & F.col(label).isNotNull())
    x = bootstrap_weights(points.sparkSession, draws, seed, n).join(both, "i")
    counted = x.groupBy("draw", "name", "score").agg(F.sum(F.when(F.col(label) == 1, F.col("w")).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) != 1, F.col("w")).otherwise(0)).alias("neg"))
    m = level_metrics(counted, ["draw", "name"], like=both, alike=["name"])
    d = m.groupBy("draw").agg(F.max(F.when(F.col("name") == "a", F.col("auc"))).alias("auc_a"), F.max(F.when(F.col("name") == "b", F.col("auc"))).alias("auc_b"))
    d = d.where(F.col("auc_a").isNotNull()).withColumn("delta", F.col("auc_b") - F.col("auc_a"))
    return d.agg(F.count(F.lit(1)).alias("draws"), F.avg("delta").alias("mean"), F.percentile("delta", F.lit(0.025)).alias("low"), F.percentile("delta", F.lit(0.975)).alias("high"))


def narrowing(observed: Column) -> Column:
    """Observed narrowing of an interval from 5 to 10 folds over the mechanical one."""
    mechanical = (T975[8] / 10**0.5) / (T975[3] / 5**0.5)
    return observed / F.lit(mechanical)

"""Rank metrics over scored points: ROC area, average precision, rate curves.

Scores are first counted by distinct value (combined before the shuffle), and
running totals are taken in two levels: within ranges of scores, and over the
ranges' totals.  So no group has to fit one task, and ties need no care.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of scores per group; each is a window of its own.
RANGES = 64


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which a null key meets a null key."""
    other = right.withColumnsRenamed({k: f"__same_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__same_{k}")) for k in keys]
    return left.join(other, on, how).drop(*(f"__same_{k}" for k in keys))


def running_totals(df: DataFrame, by: list[str], order: str, values: list[str], ranges: int = RANGES, like: DataFrame | None = None, alike: list[str] = ()) -> DataFrame:
    """Append ``<value>_before`` (sum over lower ``order`` in the group) and ``<value>_all`` (the group's sum).

    ``df`` has one row per group and value of ``order``.  The ranges are those of
    ``like`` by ``alike`` if that is given (resamples of it, say), else of ``df`` itself.
    """
    keys = by or ["__one"]
    df = df if by else df.withColumn("__one", F.lit(1))
    cut = list(alike) if like is not None else keys
    cuts = (df if like is None else like).groupBy(*cut).agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 1000).alias("__cuts"))
    # one row per group
    placed = joined(df, cuts, cut).withColumn("__range", F.size(F.filter("__cuts", lambda x: x < F.col(order)))).drop("__cuts")
    sums = placed.groupBy(*keys, "__range").agg(*(F.sum(v).alias(f"__{v}") for v in values))
    over = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    sums = sums.select(*keys, "__range", *(F.coalesce(F.sum(f"__{v}").over(over), F.lit(0)).alias(f"__{v}_low") for v in values), *(F.sum(f"__{v}").over(every).alias(f"{v}_all") for v in values))
    within = Window.partitionBy(*keys, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = joined(placed, sums, [*keys, "__range"])
    for v in values:
        out = out.withColumn(f"{v}_before", F.coalesce(F.sum(v).over(within), F.lit(0)) + F.col(f"__{v}_low"))
    return out.drop("__range", "__one", *(f"__{v}_low" for v in values))


def levels(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Positives and negatives by distinct score; null scores and labels are left out."""
    clean = df.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isNotNull())
    return clean.groupBy(*by, F.col(score).alias("score")).agg(F.sum((F.col(label) == 1).cast("bigint")).alias("pos"), F.sum((F.col(label) != 1).cast("bigint")).alias("neg"))


def numbered(df: DataFrame, order: str, name: str, ranges: int = RANGES) -> DataFrame:
    """Append ``name``: the rows' number from 0 by ``order`` (a number), counted within ranges after the ranges before."""
    cuts = df.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 1000).alias("__cuts"))
    x = df.crossJoin(F.broadcast(cuts)).withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col(order)))).drop("__cuts")  # one row
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    low = x.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__low"))
    within = Window.partitionBy("__range").orderBy(order)
    return x.join(low, "__range").withColumn(name, F.col("__low") + F.row_number().over(within) - 1).drop("__range", "__low")


def rank_metrics(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Per group ``n_pos``, ``n_neg``, ``auc`` (ties count half) and ``ap`` (steps over distinct scores).

    A group with one class only has null metrics.
    """
    return level_metrics(levels(df, score, label, by), by)


def level_metrics(counted: DataFrame, by: list[str], like: DataFrame | None = None, alike: list[str] = ()) -> DataFrame:
    """The same from positives and negatives by distinct ``score``; ``like`` and ``alike`` as in :func:`running_totals`."""
    x = running_totals(counted, by, "score", ["pos", "neg"], like=like, alike=alike)
    p, n = F.col("pos_all"), F.col("neg_all")
    tp = p - F.col("pos_before")
    called = tp + n - F.col("neg_before")
    out = x.groupBy(*by).agg(
        F.max("pos_all").cast("bigint").alias("n_pos"),
        F.max("neg_all").cast("bigint").alias("n_neg"),
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)).alias("__u"),
        F.sum(F.col("pos") * tp / called).alias("__a"),
    )
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return out.select(*by, "n_pos", "n_neg", F.when(both, F.col("__u") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"), F.when(both, F.col("__a") / F.col("n_pos")).alias("ap"))


def order_statistic(df: DataFrame, value: str, shares: list[float], by: list[str]) -> DataFrame:
    """For each share p the sorted value at index ``floor(p (n - 1))``: columns ``q<percent>``."""
    x = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    x = running_totals(x, by, "v", ["n"])
    at = lambda p: F.floor(F.lit(p) * (F.col("n_all") - 1))
    hit = lambda p: (F.col("n_before") <= at(p)) & (at(p) < F.col("n_before") + F.col("n"))
    return x.groupBy(*by).agg(*(F.max(F.when(hit(p), F.col("v"))).alias(f"q{round(100 * p)}") for p in shares))


def quantile(df: DataFrame, value: str, share: float, name: str, by: list[str] = ()) -> DataFrame:
    """``(*by, name)``: the exact quantile between neighbouring values, from counts by value in ranges; no task holds them all.

    Null and NaN values are left out; a group without values has no row, and without
    groups there is one row, which is null then.
    """
    v = F.col(value).cast("double")
    x = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by, v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    at = F.lit(float(share)) * (F.col("n_all") - 1)
    hit = lambda k: F.max(F.when((F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n")), F.col("v")))
    ends = running_totals(x, list(by), "v", ["n"]).groupBy(*by).agg(hit(F.floor(at)).alias("lo"), hit(F.ceil(at)).alias("hi"), F.max(at - F.floor(at)).alias("part"))
    return ends.select(*by, (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias(name))


def rate_curve_area(areas: DataFrame, events: DataFrame, score: str, by: list[str]) -> DataFrame:
    """Mean over events of the share of area scored below them, ties counting half: ``rate_auc``."""
    both = areas.select(*by, score, F.lit(0).alias("__y")).union(events.select(*by, score, F.lit(1).alias("__y")))
    return rank_metrics(both, score, "__y", by).select(*by, F.col("n_pos").alias("n_events"), F.col("n_neg").alias("n_area"), F.col("auc").alias("rate_auc"))


def quintile_table(areas: DataFrame, events: DataFrame, score: str, cell_km2: float) -> DataFrame:
    """Per fifth of the area (1 lowest): shares of area and events, events per 100 km2, density ratio.

    Always five rows; a fifth that ties leave without area has no density.
    """
    edges = order_statistic(areas, score, [0.2, 0.4, 0.6, 0.8], [])  # one row
    cls = lambda: (F.lit(1) + sum(((F.col(score) > F.col(f"q{p}")).cast("int") for p in (20, 40, 60, 80)), F.lit(0))).alias("class")
    counted = lambda df, name: df.where(F.col(score).isNotNull()).crossJoin(F.broadcast(edges)).groupBy(cls()).agg(F.count(F.lit(1)).alias(name))
    fifths = areas.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("class"))
    out = fifths.join(counted(areas, "n_area"), "class", "left").join(counted(events, "n_events"), "class", "left").fillna(0, ["n_area", "n_events"])
    over = Window.partitionBy()  # five rows
    share = lambda c: F.try_divide(F.col(c), F.sum(c).over(over))
    return out.select(
        F.col("class").cast("bigint").alias("class"), "n_area", "n_events", share("n_area").alias("area_share"), share("n_events").alias("event_share"),
        F.try_divide(100 * F.col("n_events"), F.col("n_area") * cell_km2).alias("per_100_km2"), F.try_divide(share("n_events"), share("n_area")).alias("density_ratio"),
    )


def captures(areas: DataFrame, events: DataFrame, score: str, shares: list[float], by: list[str] = ()) -> DataFrame:
    """``(*by, share, captured)``: share of events scored at or above the area's top ``share``.

    The threshold is the area's sorted score at index ``floor((1 - share) (n - 1))``;
    shares of 0 and 1 capture nothing and all.  Thresholds for all shares come from
    one pass over the area's distinct scores.
    """
    spark, by = areas.sparkSession, list(by)
    x = areas.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    x = running_totals(x, by, "v", ["n"])
    asked = spark.createDataFrame([(float(s),) for s in shares], "share double")
    at = F.floor((1 - F.col("share")) * (F.col("n_all") - 1))
    hit = (F.col("n_before") <= at) & (at < F.col("n_before") + F.col("n"))
    edges = x.crossJoin(F.broadcast(asked)).where(hit).select(*by, "share", F.col("v").alias("edge"))  # the asked shares
    listed = edges.groupBy(*by).agg(F.collect_list(F.struct("share", "edge")).alias("edges")) if by else edges.agg(F.collect_list(F.struct("share", "edge")).alias("edges"))
    e = events.where(F.col(score).isNotNull())
    met = (joined(e, listed, by) if by else e.crossJoin(F.broadcast(listed))).select(*by, score, F.explode("edges").alias("x"))
    share = F.col("x.share")
    caught = F.when(share <= 0, F.lit(0.0)).when(share >= 1, F.lit(1.0)).otherwise((F.col(score) >= F.col("x.edge")).cast("double"))
    return met.groupBy(*by, share.alias("share")).agg(F.avg(caught).alias("captured"))

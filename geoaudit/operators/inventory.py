"""Profiles of event inventories and region summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_by_class(df: DataFrame, cls: str, ordinal: str) -> DataFrame:
    """Classes by count, most first; ties by first appearance; null counts as ``?``."""
    x = df.groupBy(F.coalesce(F.col(cls), F.lit("?")).alias(cls)).agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("first"))
    return x.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "first")).cast("bigint"))  # one row per class


def year_profile(df: DataFrame, by: list[str], year: str = "yr", before: tuple[int, ...] = (2015, 2023)) -> DataFrame:
    """Least, most and upper-middle year, and rounded percentages before given years."""
    from geoaudit.functions.ranking import running_totals

    x = df.where(F.col(year).isNotNull()).groupBy(*by, year).agg(F.count(F.lit(1)).alias("n"))
    x = running_totals(x, by, year, ["n"])
    at = F.floor(F.col("n_all") / 2)
    mid = (F.col("n_before") <= at) & (at < F.col("n_before") + F.col("n"))
    share = lambda y: F.round(100.0 * F.sum(F.when(F.col(year) < y, F.col("n")).otherwise(0)) / F.sum("n"), 1)
    return x.groupBy(*by).agg(F.sum("n").alias("n"), F.min(year).alias("least"), F.max(year).alias("most"), F.max(F.when(mid, F.col(year))).alias("median"), *(share(y).alias(f"before_{y}") for y in before))


def top_classes(df: DataFrame, by: str, cls: str, k: int = 3) -> DataFrame:
    """The k most frequent classes of each group with their percentage (ties: the least class)."""
    x = df.groupBy(by, cls).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by)
    x = x.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), cls)).cast("bigint"))
    return x.where(F.col("rank") <= k)


def class_share(df: DataFrame, by: str, cls: Column) -> DataFrame:
    """Percentage of rows of each group that belong to a set of classes."""
    return df.groupBy(by).agg((100.0 * F.avg(cls.cast("int"))).alias("percent"), F.count(F.lit(1)).alias("n"))


def signature_by_type(df: DataFrame, type_: str, label: str, values: list[str]) -> DataFrame:
    """Means by event type, of all positives, and of the negatives, as groups of one table."""
    named = df.withColumn("grp", F.explode(F.when(F.col(label) == 1, F.array(F.col(type_), F.lit("ALL positives"))).otherwise(F.array(F.lit("negatives")))))
    return named.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *(F.avg(v).alias(v) for v in values))


def region_summary(cells: DataFrame, by: str, cell_area: float, elevation: str, value: str, limit: float) -> DataFrame:
    """Area in km2, mean elevation and the mean of ``value`` below ``limit`` in elevation, by region.

    A mean whose size is above 80 was stored in tenths and is divided by ten.
    """
    below = F.avg(F.when(F.col(elevation) < limit, F.col(value)))
    return cells.groupBy(by).agg((F.count(F.lit(1)) * abs(cell_area) / 1e6).alias("km2"), F.avg(elevation).alias("mean_elevation"), F.when(F.abs(below) > 80, below / 10).otherwise(below).alias("mean_low"))

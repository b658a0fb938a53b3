"""Scene selection and composites that skip missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoaudit.functions.ranking import running_totals


def offset_of(baseline: Column) -> Column:
    """Radiometric offset of a processing baseline: 1000 from 4.0 on; unreadable ones have none."""
    return F.when(baseline.try_cast("double") >= 4.0, F.lit(1000.0)).otherwise(F.lit(0.0))


def harmonised(dn: Column, offset: Column) -> Column:
    """A digital number without its offset, not below 0; missing stays missing."""
    return F.when(dn.isNotNull(), F.greatest(dn - offset, F.lit(0.0)))


def least_cloudy(scenes: DataFrame, k: int, limit: float, months: tuple[int, int] | None = None) -> DataFrame:
    """The k scenes of each tile with the least cloud (below ``limit``; ties by scene id).

    Ranking runs within cells of a tile first, so that a tile with very many
    scenes is cut down in parallel.
    """
    x = scenes.where(F.col("cloud") < limit)
    if months:
        x = x.where(F.month("ts").between(*months))
    order = ["cloud", "scene_id"]
    part = Window.partitionBy("tile", F.pmod(F.xxhash64("scene_id"), F.lit(32))).orderBy(*order)
    x = x.withColumn("__r", F.row_number().over(part)).where(F.col("__r") <= k)
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("tile").orderBy(*order))).where(F.col("rank") <= k).drop("__r")


def mean_composite(obs: DataFrame, by: list[str] = ("band", "cell"), value: str = "dn") -> DataFrame:
    """Mean by band and cell over the observations that are there; null where there is none."""
    return obs.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def partial_sums(obs: DataFrame, by: list[str] = ("band", "cell"), value: str = "dn") -> DataFrame:
    """Sum and count by band and cell of one batch."""
    return obs.groupBy(*by).agg(F.sum(value).alias("total"), F.count(value).alias("n"))


def merged(parts: DataFrame, by: list[str] = ("band", "cell")) -> DataFrame:
    """Mean from the partial sums of any number of batches."""
    return parts.groupBy(*by).agg(F.sum("total").alias("__t"), F.sum("n").alias("n")).select(*by, F.when(F.col("n") > 0, F.col("__t") / F.col("n")).alias("mean"), "n")


def batches(df: DataFrame, k: int, order: str, by: list[str] = ()) -> DataFrame:
    """Append ``batch``: k contiguous runs of almost equal length (the first ones longer), per group.

    Rows are numbered within ranges of ``order`` after the rows of the ranges
    before, so that no group is ordered in one task; ``order`` is a number.
    """
    x = running_totals(df.withColumn("__g", F.struct(*by) if by else F.struct(F.lit(0))).withColumn("__k", F.lit(1).cast("bigint")), ["__g"], order, ["__k"])
    size, longer = F.floor(F.col("__k_all") / k), F.col("__k_all") % k
    at = F.col("__k_before")
    early, late = F.floor(at / (size + 1)), longer + F.floor((at - longer * (size + 1)) / F.greatest(size, F.lit(1)))
    return x.withColumn("batch", F.when(at < longer * (size + 1), early).otherwise(late).cast("bigint")).select(*df.columns, "batch")

"""Feature expressions: logarithms, spectral indices, scaling, one-hot, fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoaudit.functions.ranking import quantile


def log1p_or_missing(x: Column) -> Column:
    """log(1 + x); missing below 0."""
    return F.when(x >= 0, F.log1p(x))


def log1p_clipped(x: Column) -> Column:
    """log(1 + x) with what is below 0 taken as 0."""
    return F.log1p(F.greatest(x, F.lit(0.0)))


def normalised_difference(a: Column, b: Column, scale: float = 10_000.0) -> Column:
    """(a - b) / (a + b + 1e-6) of reflectances."""
    a, b = a / scale, b / scale
    return (a - b) / (a + b + 1e-6)


def nodata_offset(bands: Column, offset: float = 1000.0) -> Column:
    """Bands less the offset, unless all of them are 0 (no data)."""
    return F.when(F.forall(bands, lambda x: x == 0), bands).otherwise(F.transform(bands, lambda x: x - offset))


def clipped_uint16(x: Column) -> Column:
    """x within the range of 16 unsigned bits, truncated."""
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(65535.0)).cast("int")


def standardised(df: DataFrame, columns: list[str], guard: float = 0.0) -> DataFrame:
    """Columns less their mean, over their population deviation (plus ``guard``); moments over all rows."""
    stats = df.agg(*(f(c).alias(f"__{c}_{n}") for c in columns for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))))
    x = df.crossJoin(F.broadcast(stats))  # one row
    return x.select(*(c for c in df.columns if c not in columns), *(((F.col(c) - F.col(f"__{c}_m")) / (F.col(f"__{c}_s") + guard)).alias(c) for c in columns))


def one_hot(x: Column, k: int) -> Column:
    """Array of k numbers, 1 at x; all 0 for a class out of range."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == x).cast("double"))


def one_hot_fitted(df: DataFrame, train: Column, column: str) -> DataFrame:
    """One-hot by the classes of the training rows; classes unseen there are all 0."""
    seen = df.where(train).agg(F.array_sort(F.collect_set(column)).alias("__seen"))  # classes, not rows
    return df.crossJoin(F.broadcast(seen)).withColumn("one_hot", F.transform("__seen", lambda v: F.coalesce(v == F.col(column), F.lit(False)).cast("double"))).drop("__seen")


def filled(df: DataFrame, columns: list[str], how: str = "global_median") -> DataFrame:
    """Missing values (null or NaN) replaced by one median over all columns, or by each column's."""
    clean = df.select(*(c for c in df.columns if c not in columns), *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns))
    if how == "global_median":
        one = quantile(clean.select(F.explode(F.array(*columns)).alias("v")), "v", 0.5, "__m")
        return clean.crossJoin(F.broadcast(one)).select(*(c for c in df.columns if c not in columns), *(F.coalesce(c, "__m").alias(c) for c in columns))
    long = clean.select(F.explode(F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("x.k", "x.v")
    each = quantile(long, "v", 0.5, "m", ["k"]).agg(*(F.max(F.when(F.col("k") == c, F.col("m"))).alias(f"__{c}") for c in columns))
    return clean.crossJoin(F.broadcast(each)).select(*(c for c in df.columns if c not in columns), *(F.coalesce(c, f"__{c}").alias(c) for c in columns))


def bucket_left(x: Column, edges: list[float]) -> Column:
    """Number of edges at or below x."""
    return F.size(F.filter(F.array(*(F.lit(e) for e in edges)), lambda e: e <= x))


def bucket_right(x: Column, edges: list[float]) -> Column:
    """Number of edges below x."""
    return F.size(F.filter(F.array(*(F.lit(e) for e in edges)), lambda e: e < x))


def cosine(a: Column, b: Column, guard: float = 1e-9) -> Column:
    """Cosine of two arrays with guarded norms."""
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return dot(a, b) / ((F.sqrt(dot(a, a)) + guard) * (F.sqrt(dot(b, b)) + guard))


def spherical(h: Column, nugget: float, sill: float, reach: float) -> Column:
    """Spherical variogram model."""
    t = h / reach
    return F.when(h >= reach, F.lit(nugget + sill)).otherwise(nugget + sill * (1.5 * t - 0.5 * t * t * t))


def exponential(h: Column, nugget: float, sill: float, reach: float) -> Column:
    """Exponential variogram model (practical range)."""
    return nugget + sill * (1 - F.exp(-3 * h / reach))


def fingerprint(df: DataFrame, columns: list[str], settings: str = "") -> DataFrame:
    """One row: a checksum of settings and of the rows as a set, without gathering them.

    Rows are hashed and summed in two halves, which does not depend on order.
    """
    h = F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns)))
    half = lambda k: F.sum(F.conv(F.substring(h, k, 12), 16, 10).cast("bigint") % 1_000_000_007).cast("string")
    return df.agg(F.md5(F.concat_ws(":", F.lit(settings), F.count(F.lit(1)).cast("string"), half(1), half(13))).alias("fingerprint"))


def feature_sets(point: list[str], spectral: list[str], point_context: list[str], spectral_context: list[str]) -> dict[str, list[str]]:
    """Columns by the name of the set: layers at the point, spectra, both, and either or both with their surroundings."""
    return {
        "A": point,
        "SPEC": spectral,
        "A_SPEC": point + spectral,
        "ACTX": point + point_context,
        "SCTX": spectral + spectral_context,
        "AFULL": point + point_context + spectral + spectral_context,
    }


def quotient(a: Column, b: Column) -> Column:
    """``a / b`` of doubles as IEEE 754 has it: a divisor of zero gives an infinity, or NaN for 0 / 0, and no error."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(F.try_divide(a, b))

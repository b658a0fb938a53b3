"""Empirical variograms and their fits by variable projection."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoaudit.functions.features import bucket_left
from geoaudit.operators.grid import pairs_within


def semivariance(points: DataFrame, key: str, value: str, edges: list[float], least: int = 30, row: str = "r", col: str = "c") -> DataFrame:
    """Per lag bin ``(bin, n, lag, gamma)``: pairs, mean distance, half the mean squared difference."""
    pairs = pairs_within(points, edges[-1], key, row, col)
    v = points.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    x = pairs.join(v.select(F.col("__k").alias("a"), F.col("__v").alias("va")), "a").join(v.select(F.col("__k").alias("b"), F.col("__v").alias("vb")), "b")
    d = F.col("va") - F.col("vb")
    out = x.withColumn("bin", bucket_left(F.col("dist"), edges)).where((F.col("bin") > 0) & (F.col("bin") < len(edges)))
    return out.groupBy(F.col("bin").cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("dist").alias("lag"), F.avg(0.5 * d * d).alias("gamma")).where(F.col("n") >= least)


def _shape(kind: str, h: Column, reach: Column) -> Column:
    t = h / reach
    return F.when(h >= reach, F.lit(1.0)).otherwise(1.5 * t - 0.5 * t * t * t) if kind == "spherical" else 1 - F.exp(-3 * t)


def fit(bins: DataFrame, reaches: list[float], kind: str = "spherical") -> DataFrame:
    """One row ``(reach, nugget, sill, sse, censored)``: the best model over a grid of ranges.

    For each range the nugget and the partial sill are the weighted least
    squares solution in closed form (weights n), held at 0 or above; ``censored``
    says that the best range is the last of the grid.
    """
    grid = bins.sparkSession.createDataFrame([(float(a),) for a in reaches], "reach double")
    g = _shape(kind, F.col("lag"), F.col("reach"))
    x = bins.crossJoin(F.broadcast(grid)).select("reach", F.col("n").cast("double").alias("w"), g.alias("g"), F.col("gamma").alias("y"))
    s = x.groupBy("reach").agg(*(F.sum(e).alias(a) for a, e in (("sw", F.col("w")), ("sg", F.col("w") * F.col("g")), ("sgg", F.col("w") * F.col("g") * F.col("g")), ("sy", F.col("w") * F.col("y")), ("sgy", F.col("w") * F.col("g") * F.col("y")))), F.array_sort(F.collect_list(F.struct("y", "w", "g"))).alias("bins"))  # lag bins, which are few
    det = F.col("sw") * F.col("sgg") - F.col("sg") * F.col("sg")
    sill = F.try_divide(F.col("sw") * F.col("sgy") - F.col("sg") * F.col("sy"), det)
    nug = (F.col("sy") - sill * F.col("sg")) / F.col("sw")
    pair = F.when(nug < 0, F.struct(F.lit(0.0).alias("nugget"), F.greatest(F.col("sgy") / F.col("sgg"), F.lit(0.0)).alias("sill"))).when((sill < 0) | sill.isNull(), F.struct((F.col("sy") / F.col("sw")).alias("nugget"), F.lit(0.0).alias("sill"))).otherwise(F.struct(nug.alias("nugget"), sill.alias("sill")))
    m = s.withColumn("p", pair).select("reach", "p.nugget", "p.sill", "bins")
    sse = F.expr("aggregate(bins, 0D, (e, b) -> e + b.w * power(b.y - nugget - sill * b.g, 2))")
    best = m.withColumn("sse", sse).agg(F.min_by(F.struct("reach", "nugget", "sill", "sse"), F.struct(F.round("sse", 9), "reach")).alias("b")).select("b.*")
    return best.withColumn("censored", F.col("reach") == float(max(reaches)))


def local_share(sill: Column, nugget: Column, drift: Column) -> Column:
    """Share of the local structure in the total; resolved from 0.10 on."""
    return F.try_divide(sill, sill + nugget + drift)


def fit_nested(bins: DataFrame, reaches: list[float], kind: str = "spherical") -> DataFrame:
    """One row ``(short, long, nugget, sill_short, sill_long, sse)``: the best two nested structures over pairs of ranges.

    For each pair of ranges the three coefficients are weighted least squares held
    at 0 or above (the best of all choices of which are 0); the bins are few.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        w, h, y = np.sqrt(g["n"].to_numpy(float)), g["lag"].to_numpy(float), g["gamma"].to_numpy(float)
        t = lambda a: h / a
        shape = (lambda a: np.where(h >= a, 1.0, 1.5 * t(a) - 0.5 * t(a) ** 3)) if kind == "spherical" else (lambda a: 1 - np.exp(-3 * t(a)))
        best = None
        for short, long in itertools.combinations(sorted(reaches), 2):
            x = np.stack([np.ones_like(h), shape(short), shape(long)], 1) * w[:, None]
            for some in itertools.chain.from_iterable(itertools.combinations(range(3), n) for n in (3, 2, 1)):
                c = np.zeros(3)
                c[list(some)] = np.linalg.lstsq(x[:, some], y * w, rcond=None)[0]
                sse = float(((x @ c - y * w) ** 2).sum())
                if (c >= -1e-12).all() and (best is None or sse < best[-1] - 1e-12):
                    best = (short, long, *np.maximum(c, 0), sse)
        return pd.DataFrame([best], columns=["short", "long", "nugget", "sill_short", "sill_long", "sse"])

    shape = "short double, long double, nugget double, sill_short double, sill_long double, sse double"
    return bins.groupBy(F.lit(0).alias("all")).applyInPandas(run, shape)  # a row for each lag bin


def semivariances(points: DataFrame, key: str, layers: list[str], edges: list[float], least: int = 30, row: str = "r", col: str = "c") -> DataFrame:
    """``(layer, bin, n, lag, gamma)``: the semivariances of several standardised layers, from one join of pairs.

    A layer is measured from its mean in population deviations; one without spread,
    and places that a layer has no value for, have no pairs.
    """
    stats = points.select(*(f(c).alias(f"{n}_{c}") for c in layers for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))))
    z = points.crossJoin(F.broadcast(stats)).select(F.col(key).alias("__k"), F.array(*(F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")) for c in layers)).alias("__z"))  # one row
    pairs = pairs_within(points, edges[-1], key, row, col)
    x = pairs.join(z.select(F.col("__k").alias("a"), F.col("__z").alias("za")), "a").join(z.select(F.col("__k").alias("b"), F.col("__z").alias("zb")), "b")
    x = x.withColumn("bin", bucket_left(F.col("dist"), edges)).where((F.col("bin") > 0) & (F.col("bin") < len(edges)))
    half = F.zip_with("za", "zb", lambda u, v: 0.5 * (u - v) * (u - v))
    long = x.select(F.col("bin").cast("bigint").alias("bin"), "dist", F.posexplode(half).alias("at", "half")).where("half IS NOT NULL")
    out = long.groupBy("at", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("dist").alias("lag"), F.avg("half").alias("gamma")).where(F.col("n") >= least)
    return out.select(F.element_at(F.array(*map(F.lit, layers)), F.col("at") + 1).alias("layer"), "bin", "n", "lag", "gamma")


#: Ways to hold some of nugget, sill and drift at 0: the determinant of the rest's normal equations (which must stand out from ``scale``) and their solution times it.
_WAYS = [
    ("w * (gg * hh - gh * gh) - g * (g * hh - gh * h) + h * (g * gh - gg * h)", "w * gg * hh", "y * (gg * hh - gh * gh) - g * (gy * hh - gh * hy) + h * (gy * gh - gg * hy)", "w * (gy * hh - gh * hy) - y * (g * hh - gh * h) + h * (g * hy - gy * h)", "w * (gg * hy - gy * gh) - g * (g * hy - gy * h) + y * (g * gh - gg * h)"),
    ("w * gg - g * g", "w * gg", "y * gg - g * gy", "w * gy - g * y", "0D"),
    ("w * hh - h * h", "w * hh", "y * hh - h * hy", "0D", "w * hy - h * y"),
    ("gg * hh - gh * gh", "gg * hh", "0D", "gy * hh - gh * hy", "gg * hy - gh * gy"),
    ("w", "0D", "y", "0D", "0D"),
    ("gg", "0D", "0D", "gy", "0D"),
    ("hh", "0D", "0D", "0D", "hy"),
]


def fit_drift(bins: DataFrame, reaches: list[float], longest: float, by: list[str]) -> DataFrame:
    """``(*by, reach, nugget, sill, drift, sse, share, resolved)``: nugget, one spherical structure and a linear drift.

    For each range of a grid the three coefficients are weighted least squares
    (weights n) held at 0 or above: of all ways to hold some at 0 the feasible one
    with the least error.  ``share`` is the local structure's part of the model at its
    range, ``sill / (nugget + sill + drift * reach)``; it is ``resolved`` from 0.10 on,
    if the range is below 0.9 of the longest lag.  A group without a solution (fewer
    bins than needed, all zero) has no row.
    """
    asked = bins.sparkSession.createDataFrame([(float(a),) for a in reaches], "reach double")
    x = bins.crossJoin(F.broadcast(asked)).select(*by, "reach", F.col("n").cast("double").alias("k"), F.col("lag").alias("l"), _shape("spherical", F.col("lag"), F.col("reach")).alias("s"), F.col("gamma").alias("v"))  # the asked ranges
    part = {"w": "k", "g": "k * s", "h": "k * l", "gg": "k * s * s", "gh": "k * s * l", "hh": "k * l * l", "y": "k * v", "gy": "k * s * v", "hy": "k * l * v"}
    sums = x.groupBy(*by, "reach").agg(*(F.sum(F.expr(e)).alias(n) for n, e in part.items()), F.array_sort(F.collect_list(F.struct("l", "k", "s", "v"))).alias("bins"))  # lag bins, which are few
    ways = [f"CASE WHEN {det} > 1e-9 * {scale} THEN named_struct('way', {i}, 'nugget', ({n}) / ({det}), 'sill', ({s}) / ({det}), 'drift', ({b}) / ({det})) END" for i, (det, scale, n, s, b) in enumerate(_WAYS)]
    each = sums.select(*by, "reach", "bins", F.explode(F.array(*map(F.expr, ways))).alias("c")).where("c.nugget >= -1e-12 AND c.sill >= -1e-12 AND c.drift >= -1e-12")
    # from the residuals: what is left of sums of squares hides which ranges fit equally well
    sse = F.expr("aggregate(bins, 0D, (e, b) -> e + b.k * power(b.v - c.nugget - c.sill * b.s - c.drift * b.l, 2))")
    fits = each.select(*by, "reach", "c.way", *(F.greatest(F.col(f"c.{p}"), F.lit(0.0)).alias(p) for p in ("nugget", "sill", "drift")), sse.alias("sse"))
    best = fits.groupBy(*by).agg(F.min_by(F.struct("reach", "nugget", "sill", "drift", "sse"), F.struct(F.round("sse", 9), "reach", "way")).alias("b")).select(*by, "b.*")
    share = F.try_divide(F.col("sill"), F.col("nugget") + F.col("sill") + F.col("drift") * F.col("reach"))
    return best.withColumn("share", F.coalesce(share, F.lit(0.0))).withColumn("resolved", (F.col("share") >= 0.10) & (F.col("reach") < 0.9 * longest))


def local_ranges(fits: DataFrame) -> DataFrame:
    """One row ``(layers, resolved, median, low, high)``: quartiles of the resolved layers' ranges."""
    reach = F.when(F.col("resolved"), F.col("reach"))
    at = lambda p: F.percentile(reach, F.lit(p))  # noqa: E731  a row for each layer
    return fits.agg(F.count(F.lit(1)).alias("layers"), F.count_if("resolved").alias("resolved"), at(0.5).alias("median"), at(0.25).alias("low"), at(0.75).alias("high"))

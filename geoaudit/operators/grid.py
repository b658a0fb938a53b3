"""Operators over grid cells: exclusion, windows, prefix sums, blocks, sampling."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoaudit.functions.ranking import quantile

def _spread(points: DataFrame, row: str, col: str, side: int, names: list[str]) -> DataFrame:
    """Each point under its own bucket of ``side`` cells and the eight around it."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    x = points.withColumn("__s", F.explode(steps))
    return x.select(*names, (F.floor(F.col(row) / side) + F.col("__s.i")).alias("__br"), (F.floor(F.col(col) / side) + F.col("__s.j")).alias("__bc"))


def exclude_near(cells: DataFrame, events: DataFrame, buffer: int, row: str = "r", col: str = "c") -> DataFrame:
    """Cells farther than ``buffer`` (inclusive square window) from every event.

    A range anti-join by buckets: events stand under the nine buckets around
    them, so the join has an equality key and each cell meets near events only.
    """
    side = buffer + 1
    near = _spread(events.select(F.col(row).alias("__er"), F.col(col).alias("__ec")).distinct(), "__er", "__ec", side, ["__er", "__ec"])
    x = cells.withColumn("__br", F.floor(F.col(row) / side)).withColumn("__bc", F.floor(F.col(col) / side))
    inside = (F.abs(F.col(row) - F.col("__er")) <= buffer) & (F.abs(F.col(col) - F.col("__ec")) <= buffer)
    same = (x["__br"] == near["__br"]) & (x["__bc"] == near["__bc"])
    return x.join(near, same & inside, "left_anti").drop("__br", "__bc")


def window_stats(points: DataFrame, cells: DataFrame, half: int, values: list[str], key: str, row: str = "r", col: str = "c") -> DataFrame:
    """Mean and population deviation of ``values`` over the square window around each point, nulls and NaN left out."""
    side = 2 * half + 1
    clean = [F.when(~F.isnan(v), F.col(v)).alias(v) for v in values]
    near = _spread(points.select(key, F.col(row).alias("__pr"), F.col(col).alias("__pc")), "__pr", "__pc", side, [key, "__pr", "__pc"])
    x = cells.select(F.col(row).alias("__r"), F.col(col).alias("__c"), *clean).withColumn("__br", F.floor(F.col("__r") / side)).withColumn("__bc", F.floor(F.col("__c") / side))
    inside = (F.abs(F.col("__r") - F.col("__pr")) <= half) & (F.abs(F.col("__c") - F.col("__pc")) <= half)
    joined = x.join(near, ["__br", "__bc"]).where(inside)
    stats = [f(v).alias(f"{v}_{n}") for v in values for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return joined.groupBy(key).agg(F.count(F.lit(1)).alias("n_cells"), *stats)


def prefix_sums(cells: DataFrame, value: str, row: str = "r", col: str = "c") -> DataFrame:
    """Two-dimensional prefix sums ``(r, c, s)`` of a full grid; one window per row, then one per column."""
    along = Window.partitionBy(row).orderBy(col).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(col).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    return cells.select(row, col, F.sum(F.coalesce(value, F.lit(0.0))).over(along).alias("__s")).select(row, col, F.sum("__s").over(down).alias("s"))


def full_grid(spark, height: int, width: int) -> DataFrame:
    """All cells ``(r, c)`` of a grid."""
    return spark.range(height * width).select(F.floor(F.col("id") / width).alias("r"), (F.col("id") % width).alias("c"))


def window_sums(sums: DataFrame, centres: DataFrame, half: int, height: int, width: int) -> DataFrame:
    """Sum over the clipped square window of each centre ``(r, c)``, from four corners of the prefix sums."""
    low = lambda x: F.greatest(x - half, F.lit(0)) - 1
    corners = F.array(
        F.struct(F.least(F.col("r") + half, F.lit(height - 1)).alias("r"), F.least(F.col("c") + half, F.lit(width - 1)).alias("c"), F.lit(1).alias("w")),
        F.struct(low(F.col("r")).alias("r"), F.least(F.col("c") + half, F.lit(width - 1)).alias("c"), F.lit(-1).alias("w")),
        F.struct(F.least(F.col("r") + half, F.lit(height - 1)).alias("r"), low(F.col("c")).alias("c"), F.lit(-1).alias("w")),
        F.struct(low(F.col("r")).alias("r"), low(F.col("c")).alias("c"), F.lit(1).alias("w")),
    )
    asked = centres.select("r", "c", F.explode(corners).alias("k")).select(F.col("r").alias("__r"), F.col("c").alias("__c"), F.col("k.r").alias("r"), F.col("k.c").alias("c"), "k.w")
    return asked.join(sums, ["r", "c"]).groupBy(F.col("__r").alias("r"), F.col("__c").alias("c")).agg(F.sum(F.col("w") * F.col("s")).alias("window_sum"))


def block_mean(cells: DataFrame, value: str, size: int, height: int, width: int, missing: float | None = None) -> DataFrame:
    """Mean of non-overlapping ``size`` x ``size`` blocks, rows and columns beyond the last whole block cropped."""
    ok = F.col(value).isNotNull() & (F.lit(True) if missing is None else F.col(value) != missing)
    x = cells.where((F.col("r") < height // size * size) & (F.col("c") < width // size * size))
    return x.groupBy(F.floor(F.col("r") / size).alias("br"), F.floor(F.col("c") / size).alias("bc")).agg(F.avg(F.when(ok, F.col(value))).alias("mean"), F.count(F.when(ok, 1)).alias("n"))


def strided_grid(height: int, width: int, stride: int, spark) -> DataFrame:
    """Centres ``(i, j, r, c)`` of a grid of every ``stride``-th cell, from half a stride on."""
    rows, cols = len(range(stride // 2, height, stride)), len(range(stride // 2, width, stride))
    x = spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("i"), (F.col("id") % cols).alias("j"))
    return x.select("i", "j", (F.col("i") * stride + stride // 2).alias("r"), (F.col("j") * stride + stride // 2).alias("c"))


def to_strided(points: DataFrame, stride: int, height: int, width: int) -> DataFrame:
    """Append the strided cell ``(i, j)`` that holds each point; null outside the grid."""
    rows, cols = len(range(stride // 2, height, stride)), len(range(stride // 2, width, stride))
    i, j = F.floor(F.col("r") / stride), F.floor(F.col("c") / stride)
    inside = (F.col("r") >= 0) & (F.col("c") >= 0) & (i < rows) & (j < cols)
    return points.withColumn("i", F.when(inside, i)).withColumn("j", F.when(inside, j))


def valid_cells(cells: DataFrame, layers: list[str]) -> DataFrame:
    """Cells whose layers are all finite."""
    return cells.where(reduce(lambda a, b: a & b, (F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) for x in layers)))


def in_bounds(height: int, width: int, margin: int, row: str = "r", col: str = "c") -> Column:
    """Whether a cell keeps ``margin`` from the grid's edge (the far side exclusive)."""
    return (F.col(row) >= margin) & (F.col(row) < height - margin) & (F.col(col) >= margin) & (F.col(col) < width - margin)


def portable_order(seed: int, *keys: str) -> Column:
    """A pseudo-random order that other engines can reproduce: md5 of seed and keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def sample_exact(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """Exactly n rows (all if there are fewer), those first in the portable order."""
    return df.orderBy(portable_order(seed, *keys), *keys).limit(n)


def sample_constrained(cells: DataFrame, positives: DataFrame, slope: str, share: float, n: int, seed: int) -> DataFrame:
    """n cells whose ``slope`` is at least the positives' percentile ``share``."""
    floor = quantile(positives, slope, share, "__floor")  # one row
    return sample_exact(cells.crossJoin(F.broadcast(floor)).where(F.col(slope) >= F.col("__floor")).drop("__floor"), n, seed, "r", "c")


def world_to_pixel(x: Column, y: Column, a: float, c: float, e: float, f: float, mode: str = "trunc") -> tuple[Column, Column]:
    """(row, col) of world coordinates on a north-up grid; ``trunc`` rounds toward zero, ``floor`` down."""
    col, row = (x - c) / a, (y - f) / e
    return (row.cast("bigint"), col.cast("bigint")) if mode == "trunc" else (F.floor(row), F.floor(col))


def pixel_to_world(row: Column, col: Column, a: float, c: float, e: float, f: float) -> tuple[Column, Column]:
    """World coordinates (x, y) of a cell's centre."""
    return c + a * (col + 0.5), f + e * (row + 0.5)


def points_dataset(cells: DataFrame, layers: list[str], height: int, width: int, buffer: int, ratio: int, side: int, seed: int = 42) -> DataFrame:
    """The labelled point table: events, and ``ratio`` times as many cells away from all of them.

    Columns ``point_id, r, c, label, block`` and the layers; cells with a missing
    layer are left out.
    """
    from geoaudit.functions.folds import block_id

    usable = valid_cells(cells, layers)
    pos = usable.where("e > 0")
    free = exclude_near(usable.where("e = 0"), cells.where("e > 0"), buffer)
    n = pos.count() * ratio
    neg = sample_exact(free, n, seed, "r", "c")
    both = pos.withColumn("label", F.lit(1).cast("bigint")).unionByName(neg.withColumn("label", F.lit(0).cast("bigint")))
    return both.select((F.col("r") * width + F.col("c")).alias("point_id"), "r", "c", "label", block_id(F.col("r"), F.col("c"), width, side).alias("block"), *layers)


def pairs_within(points: DataFrame, radius: float, key: str, row: str = "r", col: str = "c") -> DataFrame:
    """Unordered pairs ``(a, b, dist)`` of points at most ``radius`` apart, by buckets of that side."""
    side = int(radius) + 1
    near = _spread(points.select(F.col(key).alias("b"), F.col(row).alias("__r2"), F.col(col).alias("__c2")), "__r2", "__c2", side, ["b", "__r2", "__c2"])
    x = points.select(F.col(key).alias("a"), F.col(row).alias("__r1"), F.col(col).alias("__c1")).withColumn("__br", F.floor(F.col("__r1") / side)).withColumn("__bc", F.floor(F.col("__c1") / side))
    d = F.hypot((F.col("__r1") - F.col("__r2")).cast("double"), (F.col("__c1") - F.col("__c2")).cast("double"))
    return x.join(near, ["__br", "__bc"]).where(F.col("a") < F.col("b")).select("a", "b", d.alias("dist")).where(F.col("dist") <= radius)


def hole_counts(places: DataFrame, holes: DataFrame, half: int, height: int, width: int) -> DataFrame:
    """``(r, c, holes, area)``: holes in the clipped square window around each place, and the window's cells, by prefix sums."""
    full = full_grid(places.sparkSession, height, width).join(holes.select("r", "c", F.lit(1.0).alias("hole")).distinct(), ["r", "c"], "left")
    counted = window_sums(prefix_sums(full, "hole"), places.select("r", "c"), half, height, width)
    span = lambda x, n: F.least(x + half, F.lit(n - 1)) - F.greatest(x - half, F.lit(0)) + 1
    return counted.select("r", "c", F.round("window_sum").cast("bigint").alias("holes"), (span(F.col("r"), height) * span(F.col("c"), width)).alias("area"))


def gap_mask(places: DataFrame, holes: DataFrame, half: int, most: float, height: int, width: int) -> DataFrame:
    """``(r, c, gap)``: whether more than a share ``most`` of the clipped window around a place are holes."""
    return hole_counts(places, holes, half, height, width).select("r", "c", (F.col("holes") / F.col("area") > most).alias("gap"))


def inside(layer: Column, rule: str) -> Column:
    """Whether a cell lies inside by its layer: ``nonzero`` or ``positive``; missing values are outside."""
    return F.coalesce(layer != 0 if rule == "nonzero" else layer > 0, F.lit(False))


def sample_complete(candidates: DataFrame, events: DataFrame, holes: DataFrame, half: int, share: float, n: int, seed: int, height: int, width: int) -> DataFrame:
    """``n`` candidates, by a portable hash, whose windows are as complete as those of events.

    A window's hollow share counts holes and what lies beyond the edge; candidates
    may not exceed the events' quantile ``share`` of it.
    """
    whole = float((2 * half + 1) ** 2)
    hollow = lambda df: hole_counts(df, holes, half, height, width).select("r", "c", ((F.col("holes") + whole - F.col("area")) / whole).alias("hollow"))
    most = quantile(hollow(events), "hollow", share, "most")
    x = hollow(candidates).crossJoin(F.broadcast(most)).where("hollow <= most")  # one row
    return x.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("r").cast("string"), F.col("c").cast("string"))), "r", "c").limit(n).select("r", "c")


def accepted(eligible: DataFrame, n: int, seed: int, height: int, width: int, margin: int = 0, most: int = 400, strict: bool = False) -> DataFrame:
    """``(attempt, r, c)``: a rejection sample with replacement, the first ``n`` attempts that hit an eligible cell.

    Attempts are numbered and hashed to the cells that lie ``margin`` from the edge;
    there are ``most * n`` at the most.  If too few hit, the sample is smaller, or
    ``strict`` raises ValueError.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    part = lambda at, size: F.lit(margin) + F.conv(F.substring(h, at, 8), 16, 10).cast("bigint") % (size - 2 * margin)
    tries = eligible.sparkSession.range(most * n).select(F.col("id").alias("attempt"), part(1, height).alias("r"), part(9, width).alias("c"))
    out = tries.join(eligible.select(F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c")).distinct(), ["r", "c"]).orderBy("attempt").limit(n).select("attempt", "r", "c")
    if strict and (got := out.count()) < n:
        raise ValueError(f"{got} of {n} cells after {most * n} attempts")
    return out


def draws(df: DataFrame, keys: list[str], n: int, numbers: list[int]) -> DataFrame:
    """For each number a draw of ``n`` rows by a hash of its own; the least n are cut in each partition first."""
    x = df.withColumn("draw", F.explode(F.array(*map(F.lit, numbers))))
    h = F.md5(F.concat_ws(":", F.col("draw").cast("string"), *(F.col(k).cast("string") for k in keys)))
    w = Window.partitionBy("draw").orderBy("__h", *keys)
    return x.withColumn("__h", h).withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__h", "__k")


def lookup(asked: DataFrame, cells: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of ``asked`` with the cells' ``values`` and ``valid``: whether there is such a cell."""
    x = cells.select(*keys, *values, F.lit(True).alias("__there"))
    return asked.join(x, keys, "left").withColumn("valid", F.coalesce("__there", F.lit(False))).drop("__there")


def scatter(cells: DataFrame, value: str, height: int, width: int, missing: float) -> DataFrame:
    """``value`` on every cell of the grid, ``missing`` where there is none."""
    return full_grid(cells.sparkSession, height, width).join(cells.select("r", "c", value), ["r", "c"], "left").fillna(missing, [value])


#: Semi-major axis and flattening of the WGS 84 ellipsoid; scale and offsets of the UTM zones.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, EAST, SOUTH = 0.9996, 500_000.0, 10_000_000.0


def transverse_mercator(lat: Column, lon: Column, meridian: float, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing in metres of degrees on WGS 84, by the series in the third flattening (to its fourth power)."""
    n = FLATTENING / (2 - FLATTENING)
    a = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    e = 2 * math.sqrt(n) / (1 + n)
    phi, step = F.radians(lat), F.radians(lon - meridian)
    atanh = lambda x: F.log((1 + x) / (1 - x)) / 2
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(step)), atanh(F.sin(step) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for k, c in enumerate(alpha, 1):
        north = north + c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        east = east + c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    return EAST + SCALE * a * east, F.lit(SOUTH if south else 0.0) + SCALE * a * north


def decimated(cells: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th row and column, numbered anew."""
    return cells.where((F.col("r") % step == 0) & (F.col("c") % step == 0)).withColumn("r", F.floor(F.col("r") / step)).withColumn("c", F.floor(F.col("c") / step))


def rescaled(transform: tuple[float, float, float, float], step: int) -> tuple[float, float, float, float]:
    """``(pixel width, left, pixel height, top)`` of a grid of every ``step``-th pixel."""
    width, left, height, top = transform
    return width * step, left, height * step, top


def in_box(x: Column, y: Column, left: float, bottom: float, right: float, top: float) -> Column:
    """Whether a place lies in a closed box; missing places do not."""
    return F.coalesce(x.between(left, right) & y.between(bottom, top), F.lit(False))


def bounds(polygons: DataFrame, key: str, ring: str) -> DataFrame:
    """``(key, left, bottom, right, top, corners)`` of polygons given as arrays of ``(x, y)``."""
    x, y = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return polygons.select(key, F.array_min(x).alias("left"), F.array_min(y).alias("bottom"), F.array_max(x).alias("right"), F.array_max(y).alias("top"), F.size(ring).cast("bigint").alias("corners"))

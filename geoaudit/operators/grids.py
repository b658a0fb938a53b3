"""Grids as a dimension: full affine transforms, and values gathered from one grid to another.

A row of the dimension is ``(grid, height, width, xc, xr, x0, yc, yr, y0)``: the centre of
cell (r, c) lies at ``x = x0 + xc (c + 1/2) + xr (r + 1/2)`` and ``y = y0 + yc (c + 1/2)
+ yr (r + 1/2)``.  Cells of one grid find those of another by a key that is computed from
both transforms, so a gather is one equi-join, whatever the grids' sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "grid string, height int, width int, xc double, xr double, x0 double, yc double, yr double, y0 double"


def dimension(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A table of grids; a transform that flattens the plane raises ValueError."""
    for g in rows:
        if g[3] * g[7] == g[4] * g[6]:
            raise ValueError(f"grid {g[0]!r} has no inverse")
    return spark.createDataFrame(rows, SCHEMA)


def cells(grids: DataFrame) -> DataFrame:
    """``(grid, r, c, x, y)``: every cell of every grid with its centre."""
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n).cast("bigint") - 1))
    at = grids.select("*", every("height").alias("r")).select("*", every("width").alias("c"))
    centre = lambda a, b, o: F.col(o) + F.col(a) * (F.col("c") + 0.5) + F.col(b) * (F.col("r") + 0.5)
    return at.select("grid", "r", "c", centre("xc", "xr", "x0").alias("x"), centre("yc", "yr", "y0").alias("y"))


def place(x: Column, y: Column) -> tuple[Column, Column]:
    """Fractional row and column of a point on the grid whose transform is in the row."""
    det = F.col("xc") * F.col("yr") - F.col("xr") * F.col("yc")
    dx, dy = x - F.col("x0"), y - F.col("y0")
    return (F.col("xc") * dy - F.col("yc") * dx) / det, (F.col("yr") * dx - F.col("xr") * dy) / det


def nearest(targets: DataFrame, grids: DataFrame, source: str, values: DataFrame, columns: list[str]) -> DataFrame:
    """``targets`` (points ``x, y`` and others) with ``sr, sc`` and the values of the source cell that they lie in.

    ``values`` has ``r, c`` and the columns of the source grid; a point beyond the
    grid or in a cell without values has nulls.
    """
    one = grids.where(F.col("grid") == source).select("height", "width", "xc", "xr", "x0", "yc", "yr", "y0")
    r, c = place(F.col("x"), F.col("y"))
    at = targets.crossJoin(F.broadcast(one)).withColumns({"sr": F.floor(r), "sc": F.floor(c)})  # one row
    inside = F.col("sr").between(0, F.col("height") - 1) & F.col("sc").between(0, F.col("width") - 1)
    at = at.select(*targets.columns, F.when(inside, F.col("sr")).alias("sr"), F.when(inside, F.col("sc")).alias("sc"))
    return at.join(values.select(F.col("r").alias("sr"), F.col("c").alias("sc"), *columns), ["sr", "sc"], "left").select(*targets.columns, "sr", "sc", *columns)


def area_weighted(values: DataFrame, column: str, ratio: tuple[float, float], shift: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """``(r, c, mean, covered)`` on a coarser or finer grid with parallel axes, each source cell weighing as it overlaps.

    A target cell is ``ratio`` source cells high and wide, the target grid begins
    ``shift`` source cells below and right of the source's.  Missing values weigh
    nothing; ``covered`` is the share of a target cell under the others.
    """

    def spans(at: str, size: float, off: float) -> Column:
        low = F.col(at).cast("double") - off
        first, last = F.floor(low / size), F.ceil((low + 1.0) / size) - 1
        overlap = lambda k: F.least((k + 1) * size, low + 1.0) - F.greatest(k * size, low)
        return F.filter(F.transform(F.sequence(first, last), lambda k: F.struct(k.alias("k"), overlap(k).alias("w"))), lambda s: s["w"] > 1e-12)

    x = values.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    x = x.select("c", F.col(column).cast("double").alias("v"), F.explode(spans("r", ratio[0], shift[0])).alias("i")).select("v", "i", F.explode(spans("c", ratio[1], shift[1])).alias("j"))
    w = F.col("i.w") * F.col("j.w")
    return x.groupBy(F.col("i.k").alias("r"), F.col("j.k").alias("c")).agg((F.sum(w * F.col("v")) / F.sum(w)).alias("mean"), (F.sum(w) / (ratio[0] * ratio[1])).alias("covered"))


def half_stride_means(values: DataFrame, column: str, stride: int, height: int, width: int) -> DataFrame:
    """``(i, j, mean, n)``: means of blocks of ``stride`` cells that begin half a stride from the edge; incomplete ones are left out."""
    half = stride // 2
    block = lambda at: F.floor((F.col(at) - half) / stride)
    whole = lambda at, n: (F.col(at) >= half) & (F.col(at) < half + (n - half) // stride * stride)
    x = values.where(whole("r", height) & whole("c", width))
    return x.groupBy(block("r").alias("i"), block("c").alias("j")).agg(F.avg(column).alias("mean"), F.count(column).alias("n"))

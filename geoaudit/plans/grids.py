"""Queries over the grid: points, exclusion, windows, blocks, variograms, composites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoaudit.functions import features, layers, ranking
from geoaudit.operators import composite, encoder, grid, grids, variogram
from geoaudit.plans._common import rounded
from geoaudit.session import new_folder
from geoaudit.sources import views
from geoaudit.sources.views import HEIGHT, WIDTH, with_views
from geoaudit.streaming import composite as stream

B = 2
LAYERS = ["v", "q", "d", "t"]
EDGES = [1.0, 2.0, 3.5, 5.0, 7.0]


def valid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with all layers present, away from the edge by one cell, with their flat number."""
    x = grid.valid_cells(views.cells(spark, sf_dir), LAYERS).where(grid.in_bounds(HEIGHT, WIDTH, 1))
    return x.select((F.col("r") * WIDTH + F.col("c")).alias("cell_id"), "e")


def exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells farther than two cells from every event."""
    x = views.cells(spark, sf_dir)
    return grid.exclude_near(x.select("r", "c"), x.where("e > 0"), B)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled point table with blocks."""
    return rounded(grid.points_dataset(views.cells(spark, sf_dir), LAYERS, HEIGHT, WIDTH, B, 3, views.BLOCK), 8)


def window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and deviations of two layers in the 5 x 5 window around each event."""
    x = views.cells(spark, sf_dir)
    p = x.where("e > 0").select((F.col("r") * WIDTH + F.col("c")).alias("point_id"), "r", "c")
    return rounded(grid.window_stats(p, x, 2, ["q", "d"], "point_id"), 6)


def integral_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window sums of quantities around events from two-dimensional prefix sums."""
    x = views.cells(spark, sf_dir)
    full = grid.full_grid(spark, HEIGHT, WIDTH).join(x.select("r", "c", "q"), ["r", "c"], "left")
    return rounded(grid.window_sums(grid.prefix_sums(full, "q"), x.where("e > 0").select("r", "c"), 3, HEIGHT, WIDTH), 5)


def block_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of 4 x 4 blocks."""
    return rounded(grid.block_mean(views.cells(spark, sf_dir), "q", 4, HEIGHT, WIDTH, -1.0))


def strided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the cell of a grid of every fifth row and column that holds them."""
    x = grid.to_strided(views.cells(spark, sf_dir).where("e > 0").select("r", "c"), 5, HEIGHT, WIDTH)
    centres = grid.strided_grid(HEIGHT, WIDTH, 5, spark)
    return centres.join(x.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")), ["i", "j"], "left").select("i", "j", "r", "c", F.coalesce("n", F.lit(0)).alias("n_events"))


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells to world coordinates and back, by truncation and by floor."""
    x = views.cells(spark, sf_dir).where("e > 0")
    wx, wy = grid.pixel_to_world(F.col("r"), F.col("c"), 30.0, 500_000.0, -30.0, 6_000_000.0)
    x = x.select("r", "c", wx.alias("x"), wy.alias("y"))
    tr, tc = grid.world_to_pixel(F.col("x") - 45, F.col("y") + 45, 30.0, 500_000.0, -30.0, 6_000_000.0)
    fr, fc = grid.world_to_pixel(F.col("x") - 45, F.col("y") + 45, 30.0, 500_000.0, -30.0, 6_000_000.0, "floor")
    return x.select("r", "c", F.format_string("%.1f", "x").alias("x"), F.format_string("%.1f", "y").alias("y"), tr.alias("trunc_r"), tc.alias("trunc_c"), fr.alias("floor_r"), fc.alias("floor_c"))


def constrained_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 cells at least as steep as the events' lowest tenth."""
    x = views.cells(spark, sf_dir)
    return grid.sample_constrained(x.where("e = 0"), x.where("e > 0"), "q", 0.1, 100, 7).select("r", "c")


def variogram_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semivariance of quantities by lag."""
    x = views.cells(spark, sf_dir).withColumn("id", F.col("r") * WIDTH + F.col("c"))
    return rounded(variogram.semivariance(x, "id", "q", EDGES), 6)


def variogram_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spherical model of the same bins over a grid of ranges."""
    x = views.cells(spark, sf_dir).withColumn("id", F.col("r") * WIDTH + F.col("c"))
    return rounded(variogram.fit(variogram.semivariance(x, "id", "q", EDGES), [2.0, 3.0, 4.0, 5.0, 6.0]), 4)


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum and first entries of the 4 x 4 patch around each event, missing cells 0."""
    x = views.cells(spark, sf_dir)
    p = encoder.window_patches(x.where("e > 0").select((F.col("r") * WIDTH + F.col("c")).alias("point_id"), "r", "c"), x, "q", 2, "point_id")
    return rounded(p.select("point_id", F.size("patch").cast("bigint").alias("n"), F.aggregate("patch", F.lit(0.0), lambda s, v: s + v).alias("total"), F.get("patch", F.lit(0)).alias("first"), F.get("patch", F.lit(5)).alias("sixth")), 5)


def scene_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three least cloudy scenes of each tile in January with their offsets."""
    x = composite.least_cloudy(views.scenes(spark, sf_dir), 3, 20.0, (1, 1))
    return x.select("tile", "scene_id", F.col("rank").cast("bigint").alias("rank"), "cloud", composite.offset_of(F.col("baseline")).alias("offset"))


def skip_na_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Harmonised mean by band and cell."""
    x = views.observations(spark, sf_dir)
    return rounded(composite.mean_composite(x.withColumn("dn", composite.harmonised(F.col("dn"), F.lit(1000.0)))), 5)


def merged_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same mean from partial sums of four batches of scenes."""
    x = views.observations(spark, sf_dir)
    x = x.withColumn("dn", composite.harmonised(F.col("dn"), F.lit(1000.0)))
    parts = composite.partial_sums(x.withColumn("batch", F.col("scene_id") % 4), ["band", "cell", "batch"])
    return rounded(composite.merged(parts), 5)


def scene_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of seven contiguous batches of each tile's scenes."""
    x = composite.batches(views.scenes(spark, sf_dir), 7, "scene_id", ["tile"])
    return x.groupBy("tile", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("scene_id").alias("first_scene"), F.max("scene_id").alias("last_scene"))


def streamed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same mean once more, from a stream over files of observations."""
    x = views.observations(spark, sf_dir)
    folder, state, mark = (new_folder(spark, n) for n in ("observations", "state", "checkpoint"))
    x.select("scene_id", "band", "cell", composite.harmonised(F.col("dn"), F.lit(1000.0)).alias("dn")).repartition(6, "scene_id").write.parquet(folder)
    stream.start_composite(stream.read_observations(spark, folder, 2), state, mark).awaitTermination()
    return rounded(stream.read_composite(spark, state), 5)


def resumed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same mean from keyed state, by a stream that is stopped after its first batch and goes on from there."""
    x = views.observations(spark, sf_dir)
    folder, work = new_folder(spark, "observations"), new_folder(spark, "work")
    x.select("scene_id", "band", "cell", composite.harmonised(F.col("dn"), F.lit(1000.0)).alias("dn")).repartition(6, "scene_id").write.parquet(folder)
    seen = []

    def stop(number: int) -> None:
        seen.append(number)
        if len(seen) == 1:
            raise RuntimeError("stopped on purpose")

    return rounded(stream.resumable_composite(spark, folder, work, 2, after=stop), 5)


#: Two grids over the proxy's area: the layers' own, and a turned one of another resolution.
_GRIDS = [("layers", HEIGHT, WIDTH, 30.0, 0.0, 500_000.0, 0.0, -30.0, 6_000_000.0), ("turned", 25, 26, 77.0, 11.0, 499_913.0, -9.0, -71.0, 6_000_067.0)]


def spectral_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spectral layers of every cell, from the table function; the proxy layers stand for the bands."""
    x = views.cells(spark, sf_dir)
    bands = {2: F.col("v") / 10, 3: F.col("q") * 100, 4: F.col("d") * 10_000, 8: F.col("t") * 10_000, 9: F.col("v") / 20, 11: F.when(F.col("e") == 0, F.col("q") * 50), 12: F.col("d") * 5000}
    wide = x.select("r", "c", F.array(*(bands.get(i, F.lit(None).cast("double")) for i in range(1, 13))).alias("bands"))
    return rounded(layers.spectral(wide, "bands"), 12)


def grid_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers gathered to the cells of a turned grid; cells beyond the layers stay missing."""
    known = grids.dimension(spark, _GRIDS)
    turned = grids.cells(known.where("grid = 'turned'"))
    return rounded(grids.nearest(turned, known, "layers", views.cells(spark, sf_dir), ["q", "d"]).drop("x", "y"), 6)


def area_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer on a grid of cells 2.5 by 3.2 as large that begins half a cell off."""
    return rounded(grids.area_weighted(views.cells(spark, sf_dir).withColumn("q", F.when(F.col("q") > 18, F.col("q"))), "q", (2.5, 3.2), (0.5, -0.5)), 6)


def half_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of blocks of six cells that begin half a stride from the edge."""
    return rounded(grids.half_stride_means(views.cells(spark, sf_dir), "q", 6, HEIGHT, WIDTH), 6)


def spectral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices, logarithms, clipping and the no-data rule on cells."""
    x = views.cells(spark, sf_dir)
    bands = F.array(F.when(F.col("e") > 0, F.lit(0.0)).otherwise(F.col("v") / 10), F.when(F.col("e") > 0, F.lit(0.0)).otherwise(F.col("q") * 100))
    return rounded(
        x.select(
            "r", "c", features.normalised_difference(F.col("v"), F.col("q") * 1000).alias("nd"), features.log1p_or_missing(F.col("q") - 25).alias("log_missing"), features.log1p_clipped(F.col("q") - 25).alias("log_clipped"),
            features.clipped_uint16(F.col("v") * 2 - 30_000).alias("u16"), F.element_at(features.nodata_offset(bands), 1).alias("band"),
        ), 8,
    )


def standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers as z-scores with population deviations."""
    return rounded(features.standardised(views.cells(spark, sf_dir).select("r", "c", "q", "d"), ["q", "d"], 1e-9), 5)


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values replaced by one median over two layers."""
    x = views.cells(spark, sf_dir).select("r", "c", F.when(F.col("r") % 4 != 0, F.col("q")).alias("q"), F.when(F.col("c") % 5 != 0, F.col("t") * 100).alias("t"))
    return rounded(features.filled(x, ["q", "t"]))


def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by left-closed and by right-closed bucket of quantity."""
    x = views.cells(spark, sf_dir).withColumn("k", F.round("q"))
    return x.groupBy(features.bucket_left(F.col("k"), [10.0, 20.0, 25.0, 30.0]).cast("bigint").alias("left_closed"), features.bucket_right(F.col("k"), [10.0, 20.0, 25.0, 30.0]).cast("bigint").alias("right_closed")).agg(F.count(F.lit(1)).alias("n"))


def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes one-hot by those of the training rows; unseen ones are all 0."""
    x = views.inventory(spark, sf_dir).withColumn("kind", F.when(F.col("id") % 50 == 0, F.lit("rare")).otherwise(F.col("type")))
    y = features.one_hot_fitted(x, F.col("id") % 50 != 0, "kind")
    return y.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max(F.array_join(F.transform("one_hot", lambda v: v.cast("int").cast("string")), "")).alias("code"))


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksum of the event cells."""
    return features.fingerprint(views.cells(spark, sf_dir).where("e > 0"), ["r", "c"], "cells")


def landform_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of two scaled layers by band of the first, clipped at its 99th percentile of size."""
    x = views.cells(spark, sf_dir).select("r", "c", (F.col("q") / 50).alias("a"), (F.col("d") * 10).alias("b"))
    d = x.withColumn("diff", F.col("b") - F.col("a"))
    top = ranking.quantile(d.withColumn("size", F.abs("diff")), "size", 0.99, "top")
    d = d.crossJoin(F.broadcast(top)).withColumn("diff", F.least(F.greatest("diff", -F.col("top")), F.col("top")))  # one row
    band = F.when(F.col("a") < 0.2, "low").when(F.col("a") < 0.5, "middle").otherwise("high")
    return rounded(d.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.avg("diff").alias("mean_diff"), (100.0 * F.avg((F.col("diff") > 0).cast("int"))).alias("percent_higher")))


QUERIES = {
    "valid_cells": valid_cells, "exclusion": exclusion, "point_table": points, "window_stats": window_features, "window_sums": integral_image, "block_means": block_means, "strided_grid": strided, "coordinates": coordinates,
    "constrained_sample": constrained_sample, "variogram_bins": variogram_bins, "variogram_fit": variogram_fit, "patches": patches, "scene_selection": scene_selection, "mean_composite": skip_na_mean, "merged_composite": merged_mean,
    "scene_batches": scene_batches, "streamed_composite": streamed_mean, "resumed_composite": resumed_mean, "spectral_layers": spectral_layers, "grid_gather": grid_gather, "area_weighted": area_weighted, "half_stride_means": half_stride, "spectral_features": spectral, "standardised": standardised, "filled": filled, "buckets": buckets, "one_hot": one_hot, "fingerprint": fingerprint, "surface_difference": landform_surface,
}

_FREE = f"SELECT r, c FROM cells x WHERE NOT EXISTS (SELECT 1 FROM cells y WHERE y.e > 0 AND abs(x.r - y.r) <= {B} AND abs(x.c - y.c) <= {B})"
_MEAN = "SELECT band, cell, round(avg(greatest(dn - 1000, 0)), 5) + 0.0 AS mean, count(dn) AS n FROM observations GROUP BY band, cell"
_BINS = f"""WITH p AS (SELECT r * {WIDTH} + c AS id, r, c, q FROM cells),
  x AS (SELECT sqrt((a.r - b.r) ** 2 + (a.c - b.c) ** 2) AS dist, a.q - b.q AS d FROM p a JOIN p b ON a.id < b.id AND abs(a.r - b.r) <= 7 AND abs(a.c - b.c) <= 7),
  y AS (SELECT *, CAST((dist >= 1)::INT + (dist >= 2)::INT + (dist >= 3.5)::INT + (dist >= 5)::INT + (dist >= 7)::INT AS BIGINT) AS bin FROM x WHERE dist <= 7),
  bins AS (SELECT bin, count(*) AS n, avg(dist) AS lag, avg(0.5 * d * d) AS gamma FROM y WHERE bin BETWEEN 1 AND 4 GROUP BY bin HAVING count(*) >= 30)"""

ORACLE = {
    "valid_cells": with_views(f"SELECT r * {WIDTH} + c AS cell_id, e FROM cells WHERE r >= 1 AND r < {HEIGHT - 1} AND c >= 1 AND c < {WIDTH - 1}", "cells"),
    "exclusion": with_views(_FREE, "cells"),
    "point_table": with_views(
        f"""WITH free AS ({_FREE}), n AS (SELECT 3 * count(*) AS n FROM cells WHERE e > 0),
        neg AS (SELECT r, c FROM (SELECT r, c, row_number() OVER (ORDER BY md5('42:' || r || ':' || c), r, c) AS k FROM free), n WHERE k <= n),
        u AS (SELECT r, c, CAST(1 AS BIGINT) AS label FROM cells WHERE e > 0 UNION ALL SELECT r, c, 0 FROM neg)
        SELECT u.r * {WIDTH} + u.c AS point_id, u.r, u.c, label, CAST(floor(u.r / {views.BLOCK}) * ceil({WIDTH} / {views.BLOCK}) + floor(u.c / {views.BLOCK}) AS BIGINT) AS block,
          round(v, 8) + 0.0 AS v, round(q, 8) + 0.0 AS q, round(d, 8) + 0.0 AS d, round(t, 8) + 0.0 AS t FROM u JOIN cells USING (r, c)""",
        "cells",
    ),
    "window_stats": with_views(f"SELECT p.r * {WIDTH} + p.c AS point_id, count(*) AS n_cells, round(avg(x.q), 6) + 0.0 AS q_mean, round(stddev_pop(x.q), 6) + 0.0 AS q_std, round(avg(x.d), 6) + 0.0 AS d_mean, round(stddev_pop(x.d), 6) + 0.0 AS d_std FROM cells p JOIN cells x ON abs(p.r - x.r) <= 2 AND abs(p.c - x.c) <= 2 WHERE p.e > 0 GROUP BY 1", "cells"),
    "window_sums": with_views("SELECT p.r, p.c, round(sum(x.q), 5) + 0.0 AS window_sum FROM cells p JOIN cells x ON abs(p.r - x.r) <= 3 AND abs(p.c - x.c) <= 3 WHERE p.e > 0 GROUP BY p.r, p.c", "cells"),
    "block_means": with_views(f"SELECT CAST(floor(r / 4) AS BIGINT) AS br, CAST(floor(c / 4) AS BIGINT) AS bc, round(avg(q), 6) + 0.0 AS mean, count(*) AS n FROM cells WHERE r < {HEIGHT // 4 * 4} AND c < {WIDTH // 4 * 4} GROUP BY 1, 2", "cells"),
    "strided_grid": with_views("WITH g AS (SELECT i, j, i * 5 + 2 AS r, j * 5 + 2 AS c FROM (SELECT unnest(range(12)) AS i), (SELECT unnest(range(14)) AS j)) SELECT i, j, g.r, g.c, count(x.r) AS n_events FROM g LEFT JOIN cells x ON x.e > 0 AND x.r BETWEEN g.r - 2 AND g.r + 2 AND x.c BETWEEN g.c - 2 AND g.c + 2 GROUP BY ALL", "cells"),
    "coordinates": with_views("SELECT r, c, printf('%.1f', 500000 + 30 * (c + 0.5)) AS x, printf('%.1f', 6000000 - 30 * (r + 0.5)) AS y, CAST(trunc(r - 1.0) AS BIGINT) AS trunc_r, CAST(trunc(c - 1.0) AS BIGINT) AS trunc_c, CAST(floor(r - 1.0) AS BIGINT) AS floor_r, CAST(floor(c - 1.0) AS BIGINT) AS floor_c FROM cells WHERE e > 0", "cells"),
    "constrained_sample": with_views("WITH f AS (SELECT quantile_cont(q, 0.1) AS lo FROM cells WHERE e > 0) SELECT r, c FROM (SELECT r, c, row_number() OVER (ORDER BY md5('7:' || r || ':' || c), r, c) AS k FROM cells, f WHERE e = 0 AND q >= lo) WHERE k <= 100", "cells"),
    "variogram_bins": with_views(_BINS + " SELECT bin, n, round(lag, 6) + 0.0 AS lag, round(gamma, 6) + 0.0 AS gamma FROM bins", "cells"),
    "variogram_fit": with_views(
        _BINS + """, g AS (SELECT reach, n AS w, gamma AS y, CASE WHEN lag >= reach THEN 1.0 ELSE 1.5 * lag / reach - 0.5 * (lag / reach) ** 3 END AS g FROM bins, (SELECT unnest([2.0, 3.0, 4.0, 5.0, 6.0]::DOUBLE[]) AS reach)),
        s AS (SELECT reach, sum(w) AS sw, sum(w * g) AS sg, sum(w * g * g) AS sgg, sum(w * y) AS sy, sum(w * g * y) AS sgy, sum(w * y * y) AS syy FROM g GROUP BY reach),
        u AS (SELECT *, CASE WHEN sw * sgg - sg * sg <> 0 THEN (sw * sgy - sg * sy) / (sw * sgg - sg * sg) END AS b FROM s), v AS (SELECT *, (sy - b * sg) / sw AS a FROM u),
        m AS (SELECT *, CASE WHEN a < 0 THEN 0 WHEN b < 0 OR b IS NULL THEN sy / sw ELSE a END AS nugget, CASE WHEN a < 0 THEN greatest(sgy / sgg, 0) WHEN b < 0 OR b IS NULL THEN 0 ELSE b END AS sill FROM v),
        e AS (SELECT *, syy - 2 * nugget * sy - 2 * sill * sgy + nugget * nugget * sw + 2 * nugget * sill * sg + sill * sill * sgg AS sse FROM m)
        SELECT round(reach, 4) + 0.0 AS reach, round(nugget, 4) + 0.0 AS nugget, round(sill, 4) + 0.0 AS sill, round(sse, 4) + 0.0 AS sse, reach = 6.0 AS censored FROM e ORDER BY round(e.sse, 9), e.reach LIMIT 1""",
        "cells",
    ),
    "patches": with_views(
        f"""WITH p AS (SELECT r * {WIDTH} + c AS point_id, r, c FROM cells WHERE e > 0), o AS (SELECT i, j FROM (SELECT unnest(range(-2, 2)) AS i), (SELECT unnest(range(-2, 2)) AS j)),
        x AS (SELECT point_id, i, j, coalesce(q, 0) AS q FROM p CROSS JOIN o LEFT JOIN cells y ON y.r = p.r + i AND y.c = p.c + j)
        SELECT point_id, count(*) AS n, round(sum(q), 5) + 0.0 AS total, round(sum(q) FILTER (WHERE i = -2 AND j = -2), 5) + 0.0 AS first, round(sum(q) FILTER (WHERE i = -1 AND j = -1), 5) + 0.0 AS sixth FROM x GROUP BY point_id""",
        "cells",
    ),
    "scene_selection": with_views("SELECT tile, scene_id, rank, cloud, CASE WHEN try_cast(baseline AS DOUBLE) >= 4 THEN 1000.0 ELSE 0.0 END::DOUBLE AS offset FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY cloud, scene_id) AS rank FROM scenes WHERE cloud < 20 AND month(ts) = 1) WHERE rank <= 3", "scenes"),
    "mean_composite": with_views(_MEAN.replace("greatest(dn - 1000, 0)", "CASE WHEN dn IS NOT NULL THEN greatest(dn - 1000, 0) END"), "observations"),
    "scene_batches": with_views("WITH x AS (SELECT tile, scene_id, ntile(7) OVER (PARTITION BY tile ORDER BY scene_id) - 1 AS batch FROM scenes) SELECT tile, batch, count(*) AS n, min(scene_id) AS first_scene, max(scene_id) AS last_scene FROM x GROUP BY tile, batch", "scenes"),
    "spectral_features": with_views(
        "SELECT r, c, round((v / 10000 - q / 10) / (v / 10000 + q / 10 + 1e-6), 8) + 0.0 AS nd, CASE WHEN q >= 25 THEN round(ln(q - 24), 8) + 0.0 END AS log_missing, round(ln(1 + greatest(q - 25, 0)), 8) + 0.0 AS log_clipped, CAST(trunc(least(greatest(v * 2 - 30000, 0), 65535)) AS INT) AS u16, CASE WHEN e > 0 THEN 0.0 ELSE round(v / 10 - 1000, 8) + 0.0 END AS band FROM cells",
        "cells",
    ),
    "standardised": with_views("WITH m AS (SELECT avg(q) AS qm, stddev_pop(q) AS qs, avg(d) AS dm, stddev_pop(d) AS ds FROM cells) SELECT r, c, round((q - qm) / (qs + 1e-9), 5) + 0.0 AS q, round((d - dm) / (ds + 1e-9), 5) + 0.0 AS d FROM cells, m", "cells"),
    "filled": with_views("WITH x AS (SELECT r, c, CASE WHEN r % 4 <> 0 THEN q END AS q, CASE WHEN c % 5 <> 0 THEN t * 100 END AS t FROM cells), m AS (SELECT quantile_cont(v, 0.5) AS m FROM (SELECT q AS v FROM x UNION ALL SELECT t FROM x)) SELECT r, c, round(coalesce(q, m), 6) + 0.0 AS q, round(coalesce(t, m), 6) + 0.0 AS t FROM x, m", "cells"),
    "buckets": with_views("WITH x AS (SELECT round(q) AS k FROM cells) SELECT CAST((k >= 10)::INT + (k >= 20)::INT + (k >= 25)::INT + (k >= 30)::INT AS BIGINT) AS left_closed, CAST((k > 10)::INT + (k > 20)::INT + (k > 25)::INT + (k > 30)::INT AS BIGINT) AS right_closed, count(*) AS n FROM x GROUP BY 1, 2", "cells"),
    "one_hot": with_views("WITH x AS (SELECT CASE WHEN id % 50 = 0 THEN 'rare' ELSE type END AS kind, id FROM inventory), s AS (SELECT DISTINCT kind AS v FROM x WHERE id % 50 <> 0), k AS (SELECT DISTINCT kind FROM x), code AS (SELECT kind, string_agg(CASE WHEN v = kind THEN '1' ELSE '0' END, '' ORDER BY v) AS code FROM k CROSS JOIN s GROUP BY kind) SELECT kind, count(*) AS n, max(code) AS code FROM x JOIN code USING (kind) GROUP BY kind", "inventory"),
    "fingerprint": with_views("WITH h AS (SELECT md5(r || '|' || c) AS h FROM cells WHERE e > 0) SELECT md5('cells:' || count(*) || ':' || CAST(sum(CAST('0x' || substr(h, 1, 12) AS BIGINT) % 1000000007) AS BIGINT) || ':' || CAST(sum(CAST('0x' || substr(h, 13, 12) AS BIGINT) % 1000000007) AS BIGINT)) AS fingerprint FROM h", "cells"),
    "surface_difference": with_views("WITH x AS (SELECT q / 50 AS a, d * 10 - q / 50 AS diff FROM cells), t AS (SELECT quantile_cont(abs(diff), 0.99) AS top FROM x), y AS (SELECT a, least(greatest(diff, -top), top) AS diff FROM x, t) SELECT CASE WHEN a < 0.2 THEN 'low' WHEN a < 0.5 THEN 'middle' ELSE 'high' END AS band, count(*) AS n, round(avg(diff), 6) + 0.0 AS mean_diff, round(100 * avg((diff > 0)::INT), 6) + 0.0 AS percent_higher FROM y GROUP BY 1", "cells"),
}
ORACLE["merged_composite"] = ORACLE["streamed_composite"] = ORACLE["resumed_composite"] = ORACLE["mean_composite"]
ORACLE["grid_gather"] = with_views(
    f"""WITH t AS (SELECT 'turned' AS grid, r, c, 499913 + 77 * (c + 0.5::DOUBLE) + 11 * (r + 0.5::DOUBLE) AS x, 6000067 - 9 * (c + 0.5::DOUBLE) - 71 * (r + 0.5::DOUBLE) AS y FROM (SELECT unnest(range(25)) AS r), (SELECT unnest(range(26)) AS c)),
    p AS (SELECT *, CAST(floor((6000000 - y) / 30) AS BIGINT) AS sr, CAST(floor((x - 500000) / 30) AS BIGINT) AS sc FROM t),
    k AS (SELECT grid, r, c, CASE WHEN sr BETWEEN 0 AND {HEIGHT - 1} AND sc BETWEEN 0 AND {WIDTH - 1} THEN sr END AS sr, CASE WHEN sr BETWEEN 0 AND {HEIGHT - 1} AND sc BETWEEN 0 AND {WIDTH - 1} THEN sc END AS sc FROM p)
    SELECT grid, k.r, k.c, sr, sc, round(q, 6) + 0.0 AS q, round(d, 6) + 0.0 AS d FROM k LEFT JOIN cells x ON x.r = sr AND x.c = sc""",
    "cells",
)
ORACLE["area_weighted"] = with_views(
    """WITH s AS (SELECT r - 0.5::DOUBLE AS top, c + 0.5::DOUBLE AS left_, q FROM cells WHERE q > 18), t AS (SELECT i, j FROM (SELECT unnest(range(-1, 30)) AS i), (SELECT unnest(range(-1, 30)) AS j)),
    o AS (SELECT i, j, q, least((i + 1) * 2.5::DOUBLE, top + 1) - greatest(i * 2.5::DOUBLE, top) AS h, least((j + 1) * 3.2::DOUBLE, left_ + 1) - greatest(j * 3.2::DOUBLE, left_) AS w FROM s JOIN t ON top < (i + 1) * 2.5 AND top + 1 > i * 2.5 AND left_ < (j + 1) * 3.2 AND left_ + 1 > j * 3.2)
    SELECT i AS r, j AS c, round(sum(h * w * q) / sum(h * w), 6) + 0.0 AS mean, round(sum(h * w) / 8, 6) + 0.0 AS covered FROM o WHERE h > 1e-12 AND w > 1e-12 GROUP BY i, j""",
    "cells",
)
ORACLE["half_stride_means"] = with_views("SELECT (r - 3) // 6 AS i, (c - 3) // 6 AS j, round(avg(q), 6) + 0.0 AS mean, count(q) AS n FROM cells WHERE r BETWEEN 3 AND 56 AND c BETWEEN 3 AND 68 GROUP BY 1, 2", "cells")
ORACLE["spectral_layers"] = with_views(
    """WITH b AS (SELECT r, c, v / 1e5 AS blue, q / 100 AS green, d AS red, t AS nir, v / 2e5 AS nir_narrow, CASE WHEN e = 0 THEN q * 50 / 10000 END AS swir1, d / 2 AS swir2 FROM cells),
    l AS (SELECT r, c, unnest(['blue', 'green', 'red', 'nir_narrow', 'swir1', 'swir2', 'ndvi', 'nbr']) AS layer, unnest([blue, green, red, nir_narrow, swir1, swir2, (nir - red) / (nir + red + 1e-6), (nir_narrow - swir2) / (nir_narrow + swir2 + 1e-6)]) AS value FROM b)
    SELECT r, c, layer, round(value, 12) + 0.0 AS value FROM l""",
    "cells",
)

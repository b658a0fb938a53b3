"""Tables over fold reports: paired differences, ladders, sweeps, gaps and comparisons.

A report row is ``(basin, rung, model, fold, roc, pr)``.  Differences are paired on
the fold; every interval is the fold-level one of ``functions.inference``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoaudit.functions.inference import paired_intervals


def paired(reports: DataFrame, model: Column, base: Column, by: list[str], value: str = "roc") -> DataFrame:
    """``(*by, fold, delta)``: value of the rows that ``model`` marks less that of the rows ``base`` marks; both must exist."""
    one = reports.where(model).select(*by, "fold", F.col(value).alias("x"))
    two = reports.where(base).select(*by, "fold", F.col(value).alias("y"))
    return one.join(two, [*by, "fold"]).select(*by, "fold", (F.col("x") - F.col("y")).alias("delta"))


def differences(reports: DataFrame, pipelines: list[str], base: str, by: list[str], value: str = "roc") -> DataFrame:
    """``(*by, pipeline, fold, delta)`` of several pipelines against one baseline."""
    one = reports.where(F.col("model").isin(pipelines)).select(*by, F.col("model").alias("pipeline"), "fold", F.col(value).alias("x"))
    two = reports.where(F.col("model") == base).select(*by, "fold", F.col(value).alias("y"))
    return one.join(two, [*by, "fold"]).select(*by, "pipeline", "fold", (F.col("x") - F.col("y")).alias("delta"))


def control_table(reports: DataFrame, designs: list[tuple[str, str, str]], pipelines: list[str]) -> DataFrame:
    """Intervals by design, basin and pipeline; a design is (name, rung, baseline)."""
    out = None
    for name, rung, base in designs:
        d = differences(reports.where(F.col("rung") == rung), pipelines, base, ["basin"]).withColumn("design", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return paired_intervals(out, "delta", ["design", "basin", "pipeline"])


def fold_ladder(reports: DataFrame, rungs: list[str], pipelines: list[str], base: str) -> DataFrame:
    """By basin and pipeline, for each rung the mean difference and whether its interval leaves out zero."""
    m = paired_intervals(differences(reports, pipelines, base, ["basin", "rung"]), "delta", ["basin", "rung", "pipeline"])
    at = lambda r, c: F.max(F.when(F.col("rung") == r, F.col(c))).alias(f"{r.lower()}_{'mean' if c == 'mean' else 'sig'}")
    return m.groupBy("basin", "pipeline").agg(*(at(r, c) for r in rungs for c in ("mean", "t_sig")))


def significant_cells(reports: DataFrame, pipelines: list[str], base: str) -> DataFrame:
    """By rung: cells, significant ones, and how many of these are negative."""
    m = paired_intervals(differences(reports, pipelines, base, ["basin", "rung"]), "delta", ["basin", "rung", "pipeline"])
    return m.groupBy("rung").agg(F.count(F.lit(1)).alias("cells"), F.count_if("t_sig").alias("significant"), F.count_if(F.col("t_sig") & (F.col("mean") < 0)).alias("negative"))


def gap(reports: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """By basin and pipeline: interval of the paired difference of a model and its counterpart."""
    out = None
    for one, two in pairs:
        d = paired(reports, F.col("model") == one, F.col("model") == two, ["basin"]).withColumn("pipeline", F.lit(one))
        out = d if out is None else out.unionByName(d)
    return paired_intervals(out, "delta", ["basin", "pipeline"])


def layer_sweep(reports: DataFrame, layers: DataFrame, base: str) -> DataFrame:
    """By basin: the layer with the greatest mean difference (the first of equal ones), the last layer's, and the gain.

    ``layers`` maps ``model`` to ``layer``.
    """
    names = reports.join(F.broadcast(layers), "model")  # a name for each layer
    two = reports.where(F.col("model") == base).select("basin", "fold", F.col("roc").alias("y"))
    m = names.join(two, ["basin", "fold"]).groupBy("basin", "layer").agg(F.avg(F.col("roc") - F.col("y")).alias("delta"))
    best = F.max_by(F.struct("layer", "delta"), F.struct(F.round("delta", 9), -F.col("layer")))
    last = F.max_by("delta", "layer")
    return m.groupBy("basin").agg(best.alias("b"), last.alias("last_delta")).select("basin", F.col("b.layer").alias("best_layer"), F.col("b.delta").alias("best_delta"), "last_delta", (F.col("b.delta") - F.col("last_delta")).alias("gain"))


def best_pipeline(reports: DataFrame, pipelines: list[str], base: str) -> DataFrame:
    """By basin: the pipeline with the greatest mean (the first listed of equal ones) and the interval of its difference to ``base``."""
    place = F.array_position(F.array(*map(F.lit, pipelines)), F.col("model"))
    m = reports.where(F.col("model").isin(pipelines)).groupBy("basin", "model").agg(F.avg("roc").alias("mean"))
    top = m.groupBy("basin").agg(F.max_by("model", F.struct(F.round("mean", 9), -place)).alias("pipeline"))
    d = differences(reports, pipelines, base, ["basin"]).join(top, ["basin", "pipeline"])
    return paired_intervals(d, "delta", ["basin", "pipeline"])


def reproduction(stored: DataFrame, again: DataFrame, by: list[str], value: str = "roc") -> DataFrame:
    """``(*by, folds, most)``: folds that both have, and the greatest absolute difference; keys of one side drop out."""
    both = stored.select(*by, "fold", F.col(value).alias("x")).join(again.select(*by, "fold", F.col(value).alias("y")), [*by, "fold"])
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("folds"), F.max(F.abs(F.col("x") - F.col("y"))).alias("most"))


def share_matrix(members: DataFrame, basins: list[str], least: int = 1) -> DataFrame:
    """By component, widest first: its basins, how many they are, and the summed share in each basin (0 where it has none).

    ``members``: component, basin, share.  Components of fewer than ``least`` basins drop out.
    """
    sums = [F.coalesce(F.sum(F.when(F.col("basin") == b, F.col("share"))), F.lit(0.0)).alias(f"share_{b}") for b in basins]
    x = members.groupBy("component").agg(F.countDistinct("basin").alias("n_basins"), F.array_join(F.array_sort(F.collect_set("basin")), ",").alias("basins"), *sums)
    return x.where(F.col("n_basins") >= least).orderBy(F.desc("n_basins"), "component")


def matched_summary(matches: DataFrame, value: str = "cos") -> DataFrame:
    """One row: number, mean, median, and the fractions of at least 0.8 and 0.5 of matched cosines."""
    x = F.col(value)
    return matches.agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), F.avg((x >= 0.8).cast("double")).alias("ge_08"), F.avg((x >= 0.5).cast("double")).alias("ge_05"))


def top_by(df: DataFrame, criteria: dict[str, str], key: str, n: int = 3) -> DataFrame:
    """``(criterion, rank, key, value)``: the n best keys by each criterion, ``asc`` or ``desc``; ties: the least key."""
    names = F.array(*(F.struct(F.lit(c).alias("criterion"), F.col(c).cast("double").alias("value"), (F.col(c) if d == "asc" else -F.col(c)).cast("double").alias("o")) for c, d in criteria.items()))
    x = df.select(key, F.explode(names).alias("x")).select("x.criterion", key, "x.value", "x.o")
    w = Window.partitionBy("criterion").orderBy("o", key)  # a row for each number of clusters
    return x.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n).select("criterion", "rank", key, "value")

"""Readers and writers of reports, point exports and cell tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoaudit.functions.features import fingerprint

REPORT = """basin string, model string, init_mode string, modalities array<string>, splitter string, n_pos int, n_neg int,
    fold_results array<struct<fold:int,roc_A:double,pr_A:double,roc_B:double,pr_B:double,delta_roc:double,delta_pr:double,roc:double,pr:double>>"""
INVENTORY = "id string, type string, trigger string, year string, lat double, lon double"


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Fold rows of probe reports (JSON, bare NaN allowed); fields that older files lack are null."""
    raw = spark.read.schema(REPORT).option("multiLine", True).option("allowNonNumericNumbers", True).json(path)
    return raw.select("basin", "model", "init_mode", F.concat_ws("+", "modalities").alias("modalities"), "splitter", F.explode_outer("fold_results").alias("f")).select("basin", "model", "init_mode", "modalities", "splitter", "f.*")


def read_metric_maps(spark: SparkSession, path: str) -> DataFrame:
    """``(set, fold, roc, pr)`` of reports that map set names to lists of fold metrics."""
    raw = spark.read.schema("fold_metrics map<string, struct<roc: array<double>, pr: array<double>>>").option("multiLine", True).option("allowNonNumericNumbers", True).json(path)
    each = raw.select(F.explode("fold_metrics").alias("set", "m"))
    return each.select("set", F.posexplode(F.arrays_zip("m.roc", "m.pr")).alias("fold", "v")).select("set", "fold", F.col("v.roc").alias("roc"), F.col("v.pr").alias("pr"))


def read_inventory(spark: SparkSession, path: str, short_rows: str = "keep") -> DataFrame:
    """An event inventory by header names; years such as ``2015.0`` are whole numbers, others null; a blank trigger is ``?``.

    Rows with fewer fields than the header are kept with nulls, or left out with
    ``drop``; a row whose last field is there but blank is whole.
    """
    names = [f.split()[0] for f in INVENTORY.split(", ")]
    # all fields as text: what Spark then marks as corrupt has another number of fields
    plain = ", ".join(f"{n} string" for n in [*names, "__odd"])
    raw = spark.read.schema(plain).option("header", True).option("columnNameOfCorruptRecord", "__odd").csv(path)
    if short_rows == "drop":
        raw = raw.where(F.col("__odd").isNull() | F.col(names[-1]).isNotNull())
    raw = raw.withColumns({f.split()[0]: F.col(f.split()[0]).try_cast("double") for f in INVENTORY.split(", ") if f.endswith("double")})
    trigger = F.when(F.trim("trigger") == "", None).otherwise(F.trim("trigger"))
    return raw.select("id", "type", F.coalesce(trigger, F.lit("?")).alias("trigger_kind"), F.col("year").try_cast("double").cast("bigint").alias("yr"), "lat", "lon")


def write_points(points: DataFrame, path: str) -> None:
    """Export of points with coordinates to one decimal."""
    points.select("r", "c", F.format_string("%.1f", "x").alias("x"), F.format_string("%.1f", "y").alias("y"), "label", "block").write.mode("overwrite").option("header", True).csv(path)


def write_cells(cells: DataFrame, path: str, parts: list[str], missing: dict[str, float] | None = None) -> None:
    """Cell table as Parquet by partition columns, with nodata values in place of nulls."""
    cells.fillna(missing or {}).write.mode("overwrite").partitionBy(*parts).parquet(path)


def write_reports(rows: DataFrame, path: str) -> None:
    """One JSON document per row."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def markdown(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Table lines: columns by name and their format."""
    cells = [F.coalesce(F.format_string(f, F.col(c)), F.lit("")) for c, f in columns.items()]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def export_folds(folds: DataFrame, path: str, key: str) -> None:
    """Folds as Parquet, with the fingerprint of the points they belong to beside them."""
    folds.write.parquet(f"{path}/folds")
    fingerprint(folds, [key]).write.parquet(f"{path}/points")


def import_folds(spark: SparkSession, path: str, points: DataFrame, key: str) -> DataFrame:
    """Points with the folds written at ``path``; raises ValueError if they were written for other points."""
    want, got = spark.read.parquet(f"{path}/points").first()[0], fingerprint(points, [key]).first()[0]
    if want != got:
        raise ValueError(f"folds of other points: {want} is not {got}")
    return points.join(spark.read.parquet(f"{path}/folds").select(key, "fold"), key)


def write_composite(means: DataFrame, path: str, bands: list[int], tile: str = "tile", mode: str = "append") -> None:
    """Cells as one row with a 16-bit column for each band, by tile; fractions are cut off, missing bands are 0; may be appended to."""
    at = lambda b: F.coalesce(F.max(F.when(F.col("band") == b, F.least(F.greatest("mean", F.lit(0.0)), F.lit(65535.0)))), F.lit(0.0)).cast("int").alias(f"b{b:02d}")
    means.groupBy(tile, "cell").agg(*map(at, bands)).write.mode(mode).partitionBy(tile).parquet(path)

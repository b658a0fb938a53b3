"""Proxy views: the evaluation vocabulary over star-schema and event tables.

Each view exists as a frame and as SQL with the same definition, so that any
query over them can be checked by another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoaudit.session import table

#: Grid of the proxy raster.
HEIGHT, WIDTH = 60, 70
#: Side of a spatial block, in cells.
BLOCK = 9

SQL = {
    "cells": f"""
      SELECT CAST(l_orderkey % {HEIGHT} AS BIGINT) AS r, CAST(l_partkey % {WIDTH} AS BIGINT) AS c, avg(l_extendedprice) AS v, avg(l_quantity) AS q, avg(l_discount) AS d,
        avg(l_tax) AS t, CAST(max(CASE WHEN l_returnflag = 'R' AND l_quantity > 48 AND l_orderkey % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS e
      FROM lineitem GROUP BY 1, 2""",
    "scored": """
      SELECT l.doc_id, CAST(l.quality AS BIGINT) AS y, d.source AS grp, d.lang AS cls, CAST(d.n_chars AS DOUBLE) AS s, CAST(l.doc_id * 37 % 101 AS DOUBLE) AS z
      FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "inventory": """
      SELECT o_orderkey AS id, o_orderstatus AS type, o_orderpriority AS trigger_kind, CAST(year(o_orderdate) AS BIGINT) AS yr FROM orders""",
}


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster cells ``(r, c, v, q, d, t, e)``: four layers and an event flag."""
    event = (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 48) & (F.col("l_orderkey") % 7 == 0)
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_orderkey") % HEIGHT).alias("r"), (F.col("l_partkey") % WIDTH).alias("c"))
        .agg(F.avg("l_extendedprice").alias("v"), F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"), F.max(event.cast("bigint")).alias("e"))
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored points ``(doc_id, y, grp, cls, s, z)``: label, group, class and two scores."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return labels.join(docs, "doc_id").select(
        "doc_id", F.col("quality").cast("bigint").alias("y"), F.col("source").alias("grp"), F.col("lang").alias("cls"), F.col("n_chars").cast("double").alias("s"), (F.col("doc_id") * 37 % 101).cast("double").alias("z")
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event inventory ``(id, type, trigger_kind, yr)``."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("trigger_kind"), F.year("o_orderdate").cast("bigint").alias("yr"))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene catalogue ``(scene_id, tile, ts, cloud, baseline)``."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("scene_id"), (F.col("user_id") % 25).alias("tile"), "ts", F.col("value").alias("cloud"), F.when(k % 10 == 3, F.lit("x")).otherwise(F.concat(F.lit("0"), (k % 6).cast("string"), F.lit(".00"))).alias("baseline"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-band stack ``(scene_id, band, cell, dn)`` with missing values."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("scene_id"), F.col("l_linenumber").cast("bigint").alias("band"), (F.col("l_partkey") % 50).alias("cell"), F.when(F.col("l_suppkey") % 11 != 0, F.round(F.col("l_extendedprice") / 10)).alias("dn")
    )


SQL["scenes"] = """
      SELECT event_id AS scene_id, user_id % 25 AS tile, ts, value AS cloud,
        CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 10 = 3 THEN 'x' ELSE '0' || (CAST(json_extract_string(props, '$.k') AS INT) % 6) || '.00' END AS baseline FROM events"""
SQL["observations"] = """
      SELECT l_orderkey AS scene_id, CAST(l_linenumber AS BIGINT) AS band, l_partkey % 50 AS cell, CASE WHEN l_suppkey % 11 <> 0 THEN round(l_extendedprice / 10) END AS dn FROM lineitem"""


def with_views(sql: str, *names: str) -> str:
    """A statement with the named views before it."""
    recursive = "RECURSIVE " if "RECURSIVE" in sql else ""
    body = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    return f"WITH {recursive}{body}{',' if sql.lstrip().upper().startswith('WITH') else ''} {sql.lstrip().removeprefix('WITH').lstrip().removeprefix('RECURSIVE') if sql.lstrip().upper().startswith('WITH') else sql}"


#: Models of the proxy reports and their weights on two means.
MODELS = [
    ("A", 1.0, 1.0), ("AFULL", 1.2, 1.1), ("TM", 1.3, 0.9), ("PRITHVI", 0.9, 1.6), ("TM_RAND", 0.8, 1.0), ("PRITHVI_RAND", 0.7, 1.3),
    ("L0", 0.5, 1.9), ("L1", 1.5, 0.2), ("L2", 1.1, 1.4), ("L3", 1.4, 0.8),
]
SQL["reports"] = """
      SELECT basin, rung, model, fold, 0.6 + d * w1 + t * w2 AS roc, 0.3 + d * w2 + t * w1 AS pr FROM (
        SELECT l_returnflag || l_linestatus AS basin, rung, CAST(CASE rung WHEN 'R1' THEN l_orderkey %% 5 WHEN 'R2' THEN l_partkey %% 5 ELSE l_orderkey %% 10 END AS BIGINT) AS fold, avg(l_discount) AS d, avg(l_tax) AS t
        FROM lineitem, (SELECT unnest(['R1', 'R2', 'R3']) AS rung) GROUP BY ALL),
        (VALUES %s) AS m(model, w1, w2)""" % ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE)" for m, a, b in MODELS)


def fold_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold reports ``(basin, rung, model, fold, roc, pr)``."""
    rung = F.explode(F.array(*map(F.lit, ("R1", "R2", "R3")))).alias("rung")
    x = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("basin"), "l_orderkey", "l_partkey", "l_discount", "l_tax", rung)
    fold = F.when(F.col("rung") == "R1", F.col("l_orderkey") % 5).when(F.col("rung") == "R2", F.col("l_partkey") % 5).otherwise(F.col("l_orderkey") % 10)
    x = x.groupBy("basin", "rung", fold.cast("bigint").alias("fold")).agg(F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"))
    models = spark.createDataFrame(MODELS, "model string, w1 double, w2 double")
    x = x.crossJoin(F.broadcast(models))  # ten rows
    return x.select("basin", "rung", "model", "fold", (0.6 + F.col("d") * F.col("w1") + F.col("t") * F.col("w2")).alias("roc"), (0.3 + F.col("d") * F.col("w2") + F.col("t") * F.col("w1")).alias("pr"))

"""Spatial blocks and folds that keep groups whole."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def block_id(row: Column, col: Column, width: int, side: int, row_offset: int = 0, col_offset: int = 0) -> Column:
    """Number of the square block of a cell, counted along rows; offsets shift the grid."""
    across = -(-(width + (col_offset if col_offset else 0)) // side)
    return (F.floor((row + row_offset) / side) * across + F.floor((col + col_offset) / side)).cast("bigint")


def group_folds(groups: DataFrame, k: int, group: str = "grp", size: str = "n") -> DataFrame:
    """``(group, fold)``: groups by size, largest first, each into the lightest fold so far.

    Ties: the greater group first, the least fold first.  Greedy by nature: one
    task reads the groups' sizes in order (one row per spatial block, not per
    point) and holds nothing but the folds' loads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = [(0, i) for i in range(k)]
        for b in batches:
            folds = []
            for n in b.column("n").to_pylist():
                load, i = loads[0]
                heapq.heapreplace(loads, (load + n, i))
                folds.append(i)
            yield pa.RecordBatch.from_arrays([b.column("g"), pa.array(folds, pa.int64())], names=["g", "fold"])

    x = groups.select(F.col(group).alias("g"), F.col(size).cast("bigint").alias("n"))
    shape = T.StructType([x.schema["g"], T.StructField("fold", T.LongType())])
    done = x.repartition(1).sortWithinPartitions(F.desc("n"), F.desc("g")).mapInArrow(run, shape)
    return done.withColumnRenamed("g", group)


def stratified_group_folds(groups: DataFrame, k: int, group: str = "grp", pos: str = "pos", neg: str = "neg") -> DataFrame:
    """``(group, fold)``: groups by the spread of their two class counts, each where the folds' class shares stay most even.

    The criterion is the mean over classes of the deviation of the folds' shares
    of the class (compared at 9 decimals); ties go to the fold with fewer members,
    then to the least.  One task reads the groups' counts in order, as above.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, k))
        for b in batches:
            folds = []
            for p, q, tp, tq in zip(*(b.column(c).to_pylist() for c in ("p", "q", "tp", "tq")), strict=True):
                tried = held[:, None, :] + np.array([p, q])[:, None, None] * np.eye(k)
                cost = (tried / np.array([tp, tq])[:, None, None]).std(2).mean(0).round(9)
                i = min(range(k), key=lambda i: (cost[i], held[:, i].sum(), i))
                held[:, i] += p, q
                folds.append(i)
            yield pa.RecordBatch.from_arrays([b.column("g"), pa.array(folds, pa.int64())], names=["g", "fold"])

    total = groups.agg(F.greatest(F.sum(pos), F.lit(1)).cast("double").alias("tp"), F.greatest(F.sum(neg), F.lit(1)).cast("double").alias("tq"))
    x = groups.select(F.col(group).alias("g"), F.col(pos).cast("double").alias("p"), F.col(neg).cast("double").alias("q")).crossJoin(F.broadcast(total))  # one row
    shape = T.StructType([x.schema["g"], T.StructField("fold", T.LongType())])
    done = x.repartition(1).sortWithinPartitions(F.desc(F.abs(F.col("p") - F.col("q"))), F.desc("g")).mapInArrow(run, shape)
    return done.withColumnRenamed("g", group)


def stratified_folds(df: DataFrame, k: int, label: str, key: str, seed: int = 42) -> DataFrame:
    """Append ``fold``: rows of each class, in the order of a portable hash, dealt out in turn.

    The turn of a row is its rank in its class: that in a bucket of the class by
    the hash's first byte, after the rows of the buckets before.  So no class is
    ordered in one task, and a class's folds differ by one row at most.
    """
    x = df.withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))).withColumn("__b", F.substring("__h", 1, 2))
    before = Window.partitionBy("__y").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    low = x.groupBy(F.col(label).alias("__y"), F.col("__b").alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    low = low.withColumn("__low", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")  # 256 rows a class
    w = Window.partitionBy(label, "__b").orderBy("__h", key)
    x = x.withColumn("__r", F.row_number().over(w)).join(low, F.col(label).eqNullSafe(F.col("__y")) & (F.col("__b") == F.col("__c")))
    return x.withColumn("fold", ((F.col("__low") + F.col("__r") - 1) % k).cast("bigint")).drop("__h", "__b", "__y", "__c", "__low", "__r")


def fold_or_default(points: DataFrame, folds: DataFrame, block: str, k: int = 5) -> DataFrame:
    """Append ``fold`` by block; a block that no fold lists takes ``block % k``."""
    listed = folds.select(F.col(block).alias("__b"), F.col("fold").alias("__f"))
    return points.join(listed, F.col(block) == F.col("__b"), "left").withColumn("fold", F.coalesce("__f", F.col(block) % k)).drop("__b", "__f")


def single_class_folds(df: DataFrame, label: str = "y", fold: str = "fold") -> DataFrame:
    """Folds that a rank metric cannot score: ``(fold, n, n_pos)`` with one class only."""
    return df.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("bigint").alias("n_pos")).where("n_pos = 0 OR n_pos = n")


def inner_split(df: DataFrame, key: str, share: float, seed: int = 42, name: str = "held") -> DataFrame:
    """Append ``name``: whether a row is held out, by a portable hash of its key; about ``share`` of all rows are."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("bigint")
    return df.withColumn(name, h < int(share * (1 << 32)))

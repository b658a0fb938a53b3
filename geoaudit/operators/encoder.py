"""Plug-in boundary for encoders: batches of rows in, embeddings out, with a cache by fingerprint."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoaudit.functions.features import fingerprint


class Encoder(Protocol):
    """What an encoder offers: its width, and embeddings of a batch of inputs (rows x width)."""

    width: int

    def encode(self, inputs: np.ndarray) -> np.ndarray: ...


class ProjectionEncoder:
    """A deterministic stand-in: a fixed random projection followed by tanh."""

    def __init__(self, width: int = 8, seed: int = 42):
        self.width, self.seed = width, seed

    def encode(self, inputs: np.ndarray) -> np.ndarray:
        planes = np.random.Generator(np.random.Philox(self.seed)).standard_normal((inputs.shape[1], self.width))
        return np.tanh(inputs @ planes / np.sqrt(inputs.shape[1]))


def encode(df: DataFrame, make: Callable[[], Encoder], columns: list[str], key: str, chunk: int = 256) -> DataFrame:
    """``(key, embedding)``: the encoder is made once per task and fed ``chunk`` rows at a time; missing inputs are 0."""
    shape = T.StructType([df.schema[key], T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for f in frames:
            model = model or make()
            for at in range(0, len(f), chunk):
                part = f.iloc[at : at + chunk]
                x = np.nan_to_num(part[columns].to_numpy(dtype=float))
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": list(model.encode(x).astype(np.float32))})

    return df.select(key, *columns).mapInPandas(run, shape)


def cached(df: DataFrame, make: Callable[[], Encoder], columns: list[str], key: str, folder: str, settings: str) -> DataFrame:
    """Embeddings from the cache if its fingerprint is that of these rows and settings; else made anew and stored."""
    spark = df.sparkSession
    mark = fingerprint(df, [key, *columns], settings).first()[0]
    path = f"{folder.rstrip('/')}/fingerprint={mark}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        encode(df, make, columns, key).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).withColumn("fingerprint", F.lit(mark))


def window_patches(points: DataFrame, cells: DataFrame, value: str, half: int, key: str) -> DataFrame:
    """``(key, patch)``: the (2 half)^2 cells from [r - half, r + half) around each point in row order, missing ones 0."""
    offsets = F.sequence(F.lit(-half), F.lit(half - 1))
    asked = points.select(key, "r", "c", F.explode(offsets).alias("dr")).select(key, "c", (F.col("r") + F.col("dr")).alias("__r"), "dr", F.explode(offsets).alias("dc"))
    asked = asked.select(key, "dr", "dc", "__r", (F.col("c") + F.col("dc")).alias("__c"))
    got = asked.join(cells.select(F.col("r").alias("__r"), F.col("c").alias("__c"), F.col(value).alias("__v")), ["__r", "__c"], "left")
    each = got.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("dr", "dc", F.coalesce("__v", F.lit(0.0)).alias("v")))).alias("p"))  # (2 half)^2 entries
    return each.select(key, F.transform("p", lambda x: x["v"]).alias("patch"))


def band_patches(points: DataFrame, cells: DataFrame, bands: list[str], half: int, key: str, scale: float = 1.0) -> DataFrame:
    """``(key, band, patch)``: the window of :func:`window_patches` of each of some bands, over ``scale``; one join for all bands."""
    long = cells.select("r", "c", F.explode(F.array(*(F.struct(F.lit(b).alias("band"), (F.col(b) / scale).alias("v")) for b in bands))).alias("x")).select("r", "c", "x.band", "x.v")
    offsets = F.sequence(F.lit(-half), F.lit(half - 1))
    asked = points.select(key, "r", "c", F.explode(offsets).alias("dr")).select(key, "c", (F.col("r") + F.col("dr")).alias("__r"), "dr", F.explode(offsets).alias("dc"))
    asked = asked.select(key, "dr", "dc", "__r", (F.col("c") + F.col("dc")).alias("__c"))
    got = asked.join(long.select(F.col("r").alias("__r"), F.col("c").alias("__c"), "band", "v"), ["__r", "__c"])
    each = got.groupBy(key, "band").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("dr", "dc").alias("k"), "v"))).alias("m"))  # (2 half)^2 entries
    places = F.flatten(F.transform(offsets, lambda i: F.transform(offsets, lambda j: F.struct(i.alias("dr"), j.alias("dc")))))
    return each.select(key, "band", F.transform(places, lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("patch"))

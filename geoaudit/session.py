"""Session helpers: the shared folder, materialised tables and worker imports."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWNED: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what ``spark.checkpoint.dir`` of the session names.  Only where that
    is unset (tests, notebooks) a local temporary folder takes its place.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="geoaudit-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the session's process ends."""
    path = f"{shared_dir(spark)}/geoaudit-{uuid.uuid4().hex}/{name}"
    _OWNED[path] = spark
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage as ``checkpoint()`` does, but stays columnar, and lets
    several readers use the rows without computing them again.  The table
    survives the loss of any executor.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`new_folder` through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _OWNED.pop(path, None)


def dematerialise(df: DataFrame) -> None:
    """Delete the table behind a frame of :func:`materialise` that nothing reads any more."""
    for path in list(_OWNED):
        if any(path.split("://")[-1] in f for f in df.inputFiles()[:1]):
            drop_folder(df.sparkSession, path)


@atexit.register
def _tidy() -> None:
    for path, spark in list(_OWNED.items()):
        try:
            drop_folder(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone already; the folder is then left to the cluster
            return


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers of this session import the package from where the driver has it."""
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    have = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *have])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

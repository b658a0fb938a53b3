"""The incremental composite as a stream: sums and counts that survive restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geoaudit.functions.features import fingerprint
from geoaudit.operators.composite import merged, partial_sums

SCHEMA = "scene_id long, band long, cell long, dn double"


def read_observations(spark: SparkSession, folder: str, files_a_batch: int = 4) -> DataFrame:
    """A stream of the observation files of a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def start_composite(obs: DataFrame, state: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's partial sums below ``state``.

    A batch has a folder of its own and is written whole or again after a
    failure, so that no observation counts twice; the checkpoint pins the input.
    """

    def put(batch: DataFrame, number: int) -> None:
        partial_sums(batch).write.mode("overwrite").parquet(f"{state}/batch={number}")

    return obs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_composite(spark: SparkSession, state: str) -> DataFrame:
    """The mean composite of all batches written so far."""
    return merged(spark.read.parquet(state))


def manifest(spark: SparkSession, folder: str) -> str:
    """Fingerprint of the files of a folder, by name, size and time of change."""
    m = F.col("_metadata")
    files = spark.read.schema(SCHEMA).parquet(folder).select(m["file_name"].alias("name"), m["file_size"].alias("size"), m["file_modification_time"].cast("string").alias("changed")).distinct()
    return fingerprint(files, ["name", "size", "changed"]).first()[0]


def pinned(spark: SparkSession, folder: str, work: str) -> str:
    """The fingerprint that ``work`` was begun with, or now is; raises ValueError if the input has changed since."""
    now, where = manifest(spark, folder), f"{work.rstrip('/')}/manifest"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        spark.createDataFrame([(now,)], "fingerprint string").coalesce(1).write.mode("overwrite").parquet(where)
    begun = spark.read.parquet(where).first()[0]
    if begun != now:
        raise ValueError(f"the input has changed: it was {begun} and is {now}")
    return now


def resumable_composite(spark: SparkSession, folder: str, work: str, files_a_batch: int = 4, attempts: int = 3, after: Callable[[int], None] | None = None) -> DataFrame:
    """The mean composite of a folder's observations, built batch by batch and resumed where it stopped.

    Sums and counts by band and cell are keyed state of the stream, kept with the
    progress below ``work``.  A batch gives the keys that it changed with their totals
    so far, in a folder of its own that is written again if the batch is repeated, so
    nothing counts twice.  A key's result is its row of the latest batch.  The input
    is pinned: a start on other files than the first raises ValueError.  A failing
    batch is tried ``attempts`` times in all; ``after`` is called after each batch.
    """
    pinned(spark, folder, work)
    state = f"{work.rstrip('/')}/state"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/batch={number}")
        if after is not None:
            after(number)

    for attempt in range(1, attempts + 1):
        totals = read_observations(spark, folder, files_a_batch).groupBy("band", "cell").agg(F.sum("dn").alias("total"), F.count("dn").alias("n"))
        query = totals.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{work.rstrip('/')}/progress").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
            break
        except StreamingQueryException:
            if attempt == attempts:
                raise
    last = spark.read.parquet(state).groupBy("band", "cell").agg(F.max_by(F.struct("total", "n"), "batch").alias("t"))
    return last.select("band", "cell", F.when(F.col("t.n") > 0, F.col("t.total") / F.col("t.n")).alias("mean"), F.col("t.n").alias("n"))


def event_rates(events: DataFrame, window: str, lateness: str) -> DataFrame:
    """Events by type in tumbling windows of event time; later ones than the watermark are left out."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))

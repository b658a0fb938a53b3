"""The resumable composite: stopped, resumed, repeated, and refused on changed input."""

import random

import pytest
from pyspark.errors import StreamingQueryException

from geoaudit.operators import composite
from geoaudit.session import new_folder
from geoaudit.streaming import composite as stream


def folder_of(spark, seed=3):
    random.seed(seed)
    rows = [(s, s % 2, random.randrange(6), random.choice([None, float(random.randrange(5000))])) for s in range(400)]
    x = spark.createDataFrame(rows, stream.SCHEMA)
    path = new_folder(spark, "observations")
    x.repartition(8, "scene_id").write.parquet(path)
    return x, path


def shown(df):
    return {(r.band, r.cell): (None if r["mean"] is None else round(r["mean"], 6), r.n) for r in df.collect()}


def test_killed_between_batches_and_resumed(spark):
    x, path = folder_of(spark)
    work, ran = new_folder(spark, "work"), []

    def kill(number):
        ran.append(number)
        if number == 2:
            raise RuntimeError("killed")

    with pytest.raises(StreamingQueryException):
        stream.resumable_composite(spark, path, work, 1, attempts=1, after=kill)
    assert ran == [0, 1, 2]
    again = []
    got = stream.resumable_composite(spark, path, work, 1, after=again.append)
    assert again[0] == 2 and 0 not in again  # the batch that was not finished is repeated, no other
    assert shown(got) == shown(composite.mean_composite(x))
    assert shown(stream.resumable_composite(spark, path, work, 1)) == shown(got)  # nothing is left to do


def test_a_failing_batch_is_tried_again(spark):
    x, path = folder_of(spark, 4)
    failures = iter([True, True, False])

    def fail(number):
        if number == 1 and next(failures, False):
            raise OSError("lost")

    got = stream.resumable_composite(spark, path, new_folder(spark, "work"), 2, attempts=3, after=fail)
    assert shown(got) == shown(composite.mean_composite(x))


def test_changed_input_is_refused(spark):
    x, path = folder_of(spark, 5)
    work = new_folder(spark, "work")
    stream.resumable_composite(spark, path, work, 4)
    x.limit(3).write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="changed"):
        stream.resumable_composite(spark, path, work, 4)

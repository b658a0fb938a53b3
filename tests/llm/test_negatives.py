"""Hard negatives against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geoaudit.llm import negatives as N

SHAPE = "vec_id long, embedding array<double>, label int"


def plain(rows, step, positives=5, negatives=10):
    kept = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(max(-N.MOST, min(N.MOST, math.floor(max(-1e300, min(1e300, 256 * x))))) for x in v)
        kept[i] = min(kept.get(i, (label, q)), (label, q))
    out = []
    for a, (label, q) in kept.items():
        if a % step:
            continue
        score = {i: sum(x * y for x, y in zip(q, p, strict=True)) for i, (_, p) in kept.items() if i != a and len(p) == len(q)}
        near = sorted((i for i in score if kept[i][0] == label), key=lambda i: (-score[i], i))[:positives]
        for p in near:
            far = sorted((i for i in score if kept[i][0] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]), key=lambda i: (-score[i], i))[:negatives]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(far)]
    return sorted(out)


def mined(spark, rows, step):
    df = spark.createDataFrame(rows, SHAPE).selectExpr("*", "1 AS id", "2 AS q", "3 AS score")
    return sorted(tuple(r) for r in N.mine(N.quantised(df, "vec_id", "embedding", F.col("label")), F.col("id") % step == 0).collect())


def vectors(seed, n, dim=6):
    random.seed(seed)
    return [(i, [random.uniform(0, 1) for _ in range(dim)], random.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("gather", [64, 10])
def test_as_loops_find_them(spark, monkeypatch, gather):
    monkeypatch.setattr(N, "GATHER", gather)
    rows = vectors(1, 260)
    assert mined(spark, rows, 20) == plain(rows, 20)


def test_crowds_of_equal_vectors_are_told_apart_by_their_ids(spark):
    random.seed(2)
    rows = vectors(3, 120)
    copy = [0.5] * 6
    rows += [(10_000 + 37 * i, copy, i % 2) for i in range(400)]
    rows += [(-(1 << 63) + 5, copy, 1), ((1 << 63) - 1, copy, 0)]
    assert mined(spark, rows, 40) == plain(rows, 40)


def test_odd_rows(spark):
    rows = vectors(4, 60)
    rows += [(None, [1.0] * 6, 1), (200, None, 1), (220, [1.0] * 6, None), (240, [1.0] * 5 + [None], 1), (260, [float("nan")] * 6, 1), (280, [float("inf")] + [1.0] * 5, 2)]
    rows += [(0, [2.0] * 6, 2), (20, rows[20][1], rows[20][2]), (300, [1.0, 2.0], 0), (301, [1.0, 2.0], 0), (302, [1.0, 1.0], 1), (320, [], 1), (340, [1e30, -1e30, 0.0, 1.0, 1.0, 1.0], 1), (341, [1e30, 0.0, 0.0, 1.0, 1.0, 1.0], 1)]
    assert mined(spark, rows, 20) == plain(rows, 20)
    assert mined(spark, [], 20) == []


def test_rows_of_one_label_have_no_negatives(spark):
    rows = [(i, v, 1) for i, v, _ in vectors(5, 30)]
    assert mined(spark, rows, 10) == []

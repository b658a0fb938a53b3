"""The table function against the built-in form, and components against a plain decomposition."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from geoaudit.functions import layers
from geoaudit.operators import pca


def test_layers_are_those_of_stack(spark):
    rows = [(1, [float(i * i) for i in range(12)]), (2, [None] * 12), (3, None), (4, [1.0, 2.0]), (5, [0.0] * 12)]
    x = spark.createDataFrame(rows, "id int, b array<double>")
    got = {(r.id, r.layer): r.value for r in layers.spectral(x, "b").collect()}
    at = lambda i: F.get(F.col("b"), F.lit(i - 1)) / 10_000
    ratio = lambda i, j: (at(i) - at(j)) / (at(i) + at(j) + 1e-6)
    wide = x.select("id", *(at(i).alias(n) for n, i in layers.SINGLE.items()), *(ratio(*p).alias(n) for n, p in layers.RATIO.items()))
    stack = wide.selectExpr("id", f"stack({len(layers.LAYERS)}, {', '.join(f"'{n}', {n}" for n in layers.LAYERS)}) AS (layer, value)")
    want = {(r.id, r.layer): r.value for r in stack.collect()}
    assert got.keys() == want.keys() and len(got) == 40
    assert all(got[k] == want[k] if want[k] is None else got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_unknown_layers_fail_before_any_row_is_read(spark):
    x = spark.createDataFrame([(1, [1.0])], "id int, b array<double>")
    with pytest.raises(PySparkException, match="unknown layers: violet"):
        layers.spectral(x, "b", ["blue", "violet"]).schema  # noqa: B018
    with pytest.raises(PySparkException, match="array"):
        layers.spectral(x, "id").schema  # noqa: B018


def test_components_are_those_of_a_plain_decomposition(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((300, 5)) @ r.standard_normal((5, 5)) + 1e5
    x[:, 4] = 7.0  # no spread
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    c, rows = pca.fit(df, "id", "v", 3)
    s = np.where(x.std(0) > 0, x.std(0), 1)
    z = (x - x.mean(0)) / s
    _, w, axes = np.linalg.svd(z, full_matrices=False)
    assert c.variances == pytest.approx(w[:3] ** 2 / 299, rel=1e-9)
    assert c.shares == pytest.approx(w[:3] ** 2 / (w**2).sum(), rel=1e-9)
    assert c.loadings @ c.loadings.T == pytest.approx(np.eye(3), abs=1e-9)
    assert np.abs((c.loadings * axes[:3]).sum(1)) == pytest.approx(np.ones(3), abs=1e-9)
    assert all(row[np.abs(row).argmax()] > 0 for row in c.loadings)
    got = {q.id: q.pc for q in pca.transformed(rows, c).collect()}
    assert np.array([got[i] for i in range(300)]) == pytest.approx(z @ c.loadings.T, abs=1e-6)
    part, every = pca.fit(df, "id", "v", 2, share=0.5)
    assert every.count() == 300 and not np.allclose(part.centre, c.centre, rtol=0, atol=1e-9)
    with pytest.raises(ValueError, match="rows"):
        pca.fit(df.limit(1), "id", "v", 2)

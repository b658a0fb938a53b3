"""Mixtures and mini-batch k-means against plain loops."""

import hashlib
import math

import numpy as np
import pytest

from geoaudit.operators import minibatch, mixtures


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


def plain(x, k, rounds, tolerance, ridge=1e-4, seed=42):
    order = sorted(range(len(x)), key=lambda i: (hashlib.md5(f"{seed}:{k}:{i}".encode()).hexdigest(), i))[:k]
    w, m, v = [1 / k] * k, [x[i].copy() for i in order], [x.var(0) + ridge for _ in range(k)]

    def density(row, j):
        return math.log(w[j]) - 0.5 * sum(math.log(2 * math.pi * b) + (a - c) ** 2 / b for a, b, c in zip(row, v[j], m[j], strict=True))

    before, used = None, 0
    for _ in range(rounds):
        shares, total = [], 0.0
        for row in x:
            p = [density(row, j) for j in range(k)]
            top = max(p)
            s = top + math.log(sum(math.exp(q - top) for q in p))
            total += s
            shares.append([math.exp(q - s) for q in p])
        shares = np.array(shares)
        n = shares.sum(0)
        w = (n / n.sum()).tolist()
        m = [(shares[:, j, None] * x).sum(0) / n[j] for j in range(k)]
        v = [(shares[:, j, None] * (x - m[j]) ** 2).sum(0) / n[j] + ridge for j in range(k)]
        used += 1
        if before is not None and abs(total - before) / len(x) < tolerance:
            break
        before = total
    final = 0.0
    for row in x:
        p = [density(row, j) for j in range(k)]
        final += max(p) + math.log(sum(math.exp(q - max(p)) for q in p))
    return final, np.array(w), np.array(m), np.array(v), used


def test_expectation_maximisation(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(1e4, 1, (120, 3)), r.normal(1e4 + 4, 2, (80, 3))])
    got, n = mixtures.fit(table(spark, x), "id", "v", [1, 2, 3], rounds=6, tolerance=0.0)
    for k in (1, 2, 3):
        ll, w, m, v, _ = plain(x, k, 6, 0.0)
        assert got[k].log_likelihood == pytest.approx(ll, rel=1e-9)
        assert got[k].weights == pytest.approx(w, abs=1e-9) and got[k].means == pytest.approx(m, abs=1e-6) and got[k].variances == pytest.approx(v, abs=1e-6)
        assert got[k].bic(n) == pytest.approx(-2 * ll + (k - 1 + 6 * k) * math.log(200), rel=1e-9)
    ended, _ = mixtures.fit(table(spark, x), "id", "v", [2], tolerance=1e-3)
    assert ended[2].converged and ended[2].rounds == plain(x, 2, 200, 1e-3)[4]
    labels = {r.id: r.component for r in mixtures.assigned(table(spark, x), "id", "v", ended[2]).collect()}
    sides = [np.bincount([labels[i] for i in part], minlength=2) for part in (range(120), range(120, 200))]
    assert sides[0].max() > 110 and sides[1].max() > 70 and sides[0].argmax() != sides[1].argmax()


def test_odd_vectors(spark):
    rows = [(1, [0.0]), (2, [0.0]), (3, None), (4, [None]), (None, [1.0])]
    got, n = mixtures.fit(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", [1, 2, 3])
    assert n == 2 and sorted(got) == [1, 2]
    assert got[2].log_likelihood == pytest.approx(2 * -0.5 * math.log(2 * math.pi * 1e-4))
    empty = spark.createDataFrame([], "id long, v array<double>")
    assert mixtures.selection(empty, "id", "v", [2]).count() == 0
    with pytest.raises(ValueError, match="values"):
        mixtures.fit(spark.createDataFrame([(1, [0.0]), (2, [0.0, 1.0])], "id long, v array<double>"), "id", "v", [1])
    assert minibatch.fit(empty, "id", "v", 3, [minibatch.Run(1)])[0][0][1] == 0.0


def loops(x, k, run, batch_of, batches, rounds, sample):
    """The same rounds, a row at a time."""
    fits = []
    seen = run.sees(np.arange(len(x)))
    for s in range(run.starts):
        c = minibatch.seeded(np.array(sample[s :: run.starts]), x[sample[s :: run.starts]], k, run.seed * 1000 + s)
        count = np.zeros(len(c))
        for turn in range(rounds):
            total, got = np.zeros_like(c), np.zeros(len(c))
            for i in range(len(x)):
                if batch_of[i] == turn % batches and seen[i]:
                    j = int(((c - x[i]) ** 2).sum(1).argmin())
                    total[j] += x[i]
                    got[j] += 1
            count += got
            for j in range(len(c)):
                if got[j]:
                    c[j] += (total[j] - got[j] * c[j]) / count[j]
        cost = sum(((c - x[i]) ** 2).sum(1).min() for i in range(len(x)) if seen[i])
        fits.append((cost, s, c))
    return min(fits, key=lambda f: f[:2])


def test_mini_batches(spark):
    r = np.random.default_rng(5)
    x = r.standard_normal((500, 3)) + 6 * r.integers(0, 4, 500)[:, None]
    df = table(spark, x)
    runs = [minibatch.Run(1), minibatch.Run(2, share=0.7, starts=2)]
    fits, rows = minibatch.fit(df, "id", "v", 4, runs, batch=100, rounds=12)
    dealt = {q.id: (q.b, q.h) for q in df.selectExpr("id", "pmod(xxhash64(id), 5) AS b", "xxhash64(id) AS h").collect()}
    sample = sorted(range(500), key=lambda i: (dealt[i][1], i))[: minibatch.OVER * 4 * 3]
    for run, (centres, cost) in zip(runs, fits, strict=True):
        want, _, c = loops(x, 4, run, [dealt[i][0] for i in range(500)], 5, 12, sample)
        assert cost == pytest.approx(want, rel=1e-9)
        assert centres[centres[:, 0].argsort()] == pytest.approx(c[c[:, 0].argsort()], abs=1e-9)  # equal starts may differ in their order
    labels = minibatch.labelled(rows, fits).collect()
    assert len(labels) == 1000
    for q in labels:
        assert q.label == int(((fits[q.run][0] - x[q.id]) ** 2).sum(1).argmin())
    assert 0.6 < runs[1].sees(np.arange(500)).mean() < 0.8


def test_seeds_spread_over_the_sample():
    v = np.repeat(np.array([[0.0], [50.0], [90.0]]), 40, 0)
    assert sorted(minibatch.seeded(np.arange(120), v, 3, 1)[:, 0].tolist()) == [0.0, 50.0, 90.0]
    assert len(minibatch.seeded(np.arange(2), v[:2], 5, 1)) == 2

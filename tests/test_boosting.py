"""Leaf-wise boosting against plain loops over all rows."""

import math

import numpy as np
import pytest

from geoaudit.operators import boosting


def table(spark, x, y):
    rows = [(i, *(None if math.isnan(a) else float(a) for a in v), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double")


def split(x, g, h, edges, l2, least):
    """The best split of some rows by trying all."""
    best = (0.0, None)
    score = lambda s, e: s * s / (e + l2)
    for f in range(x.shape[1]):
        missing = np.isnan(x[:, f])
        for side in (False, True) if missing.any() else (False,):
            for e in [*edges[f], np.inf]:  # the last: values from missing ones
                left = np.where(missing, side, x[:, f] <= e)
                if min(left.sum(), (~left).sum()) < least:
                    continue
                gain = score(g[left].sum(), h[left].sum()) + score(g[~left].sum(), h[~left].sum()) - score(g.sum(), h.sum())
                if gain > best[0] + 1e-9:
                    best = (gain, (f, e, side))
    return best


def plain(x, y, edges, rounds, leaves, rate, l2, least):
    """Scores and, by tree, the splits in the order of growth."""
    f = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)
        parts, splits = [np.arange(len(y))], []
        found = [split(x, g, h, edges, l2, least)]
        while len(parts) < leaves and max(s[0] for s in found) > 0:
            k = max(range(len(parts)), key=lambda i: (round(found[i][0], 9), -i))
            gain, (j, e, side) = found.pop(k)
            rows = parts.pop(k)
            left = np.where(np.isnan(x[rows, j]), side, x[rows, j] <= e)
            splits.append((j, round(float(e), 9), side, round(gain, 6)))
            for part in (rows[left], rows[~left]):
                parts.append(part)
                found.append(split(x[part], g[part], h[part], edges, l2, least))
        for part in parts:
            f[part] += rate * -g[part].sum() / (h[part].sum() + l2)
        trees.append(sorted(splits))
    return 1 / (1 + np.exp(-f)), trees


@pytest.mark.parametrize(("leaves", "l2"), [(7, 0.0), (4, 1.5)])
def test_gains_and_splits_are_those_of_plain_loops(spark, leaves, l2):
    r = np.random.default_rng(4)
    x = r.standard_normal((400, 3))
    x[r.random((400, 3)) < 0.1] = np.nan
    x[:, 2] = np.round(x[:, 2])
    y = ((np.nan_to_num(x[:, 0]) * np.nan_to_num(x[:, 1]) + np.isnan(x[:, 2]) + r.normal(0, 0.5, 400)) > 0.2).astype(float)
    df = table(spark, x, y)
    m = boosting.fit(df, ["a", "b", "c"], rounds=3, leaves=leaves, rate=0.3, l2=l2, least=12, bins=24)
    scores, trees = plain(x, y, m.edges, 3, leaves, 0.3, l2, 12)
    cut = lambda n: [*m.edges[n.feature], np.inf][n.bin]
    mine = [sorted((n.feature, round(float(cut(n)), 9), bool(n.missing_left), round(n.gain, 6)) for n in t if n.left >= 0) for t in m.trees]
    assert mine == trees
    assert all(sum(n.left < 0 for n in t) <= leaves for t in m.trees)
    got = {q.id: q.score for q in boosting.score(df, m).collect()}
    assert [got[i] for i in range(400)] == pytest.approx(scores, abs=1e-9)


def test_odd_tables(spark):
    x, y = np.arange(60.0).reshape(20, 3), np.array([0.0, 1.0] * 10)
    df = table(spark, x, y)
    assert boosting.fit(df.where("y = 1"), ["a"]).base == 40.0
    none = boosting.fit(df.limit(0), ["a", "b"], rounds=2)
    assert none.base == 0.0 and not none.trees
    hollow = df.selectExpr("id", "CAST(NULL AS double) AS a", "b", "c", "IF(id = 3, NULL, y) AS y", "1 AS score", "2 AS bins", "3 AS f")
    m = boosting.fit(hollow, ["a", "b"], rounds=2, least=2)
    out = boosting.score(hollow, m)
    assert out.columns == ["id", "a", "b", "c", "y", "bins", "f", "score"] and out.where("score BETWEEN 0 AND 1").count() == 20
    assert all(n.feature != 0 for t in m.trees for n in t if n.left >= 0)

"""Density clustering against plain loops from the top down."""

import numpy as np
import pytest

from geoaudit.operators import density, pivots


def reach(x, samples):
    d = np.sqrt(np.round(((x[:, None] - x[None]) ** 2).sum(2), 12))
    core = np.sort(d, 1)[:, min(samples, len(x)) - 1]
    return np.maximum(np.maximum(np.maximum(core[:, None], core[None]), d), density.LEAST)


def spanning(w):
    """Prim's tree."""
    n = len(w)
    inside, best, by, out = {0}, w[0].copy(), np.zeros(n, int), []
    best[0] = np.inf
    for _ in range(n - 1):
        j = int(np.argmin(best))
        out.append((best[j], int(by[j]), j))
        inside.add(j)
        closer = (w[j] < best) & ~np.isin(np.arange(n), list(inside))
        by[closer], best[closer] = j, w[j][closer]
        best[j] = np.inf
    return out


def parts(nodes, edges):
    near = {n: [] for n in nodes}
    for _, a, b in edges:
        near[a].append(b)
        near[b].append(a)
    out, seen = [], set()
    for n in nodes:
        if n not in seen:
            todo, comp = [n], set()
            while todo:
                m = todo.pop()
                if m not in comp:
                    comp.add(m)
                    todo += near[m]
            seen |= comp
            out.append(comp)
    return out


def plain(x, size, samples):
    labels = [-1] * len(x)
    if len(x) < size:
        return labels

    def condense(nodes, edges, top, root):
        """(worth, [sets of points chosen])."""
        stability, now = 0.0, set(nodes)
        while True:
            level = max(w for w, _, _ in edges)
            comps = parts(now, [e for e in edges if e[0] < level])
            big = [c for c in comps if len(c) >= size]
            rate = 1 / level - top
            if len(big) != 1:
                stability += rate * len(now)
                worth, chosen = 0.0, []
                for c in big:
                    v, s = condense(c, [e for e in edges if e[1] in c and e[2] in c and e[0] < level], 1 / level, False)
                    worth += v
                    chosen += s
                if root or (big and stability < worth):
                    return worth, chosen
                return stability, [set(nodes)]
            stability += rate * (len(now) - len(big[0]))
            now = big[0]
            edges = [e for e in edges if e[1] in now and e[2] in now and e[0] < level]

    _, chosen = condense(set(range(len(x))), spanning(reach(x, samples)), 0.0, True)
    for c in chosen:
        for i in c:
            labels[i] = min(c)
    return labels


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


def blobs(seed, n, centres=4, dim=2):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim)) * r.uniform(0.2, 1.2, centres)[r.integers(0, centres, n)][:, None] + 9 * r.integers(0, centres, n)[:, None]
    x[: n // 8] = r.uniform(-10, 40, (n // 8, dim))  # noise
    return x


@pytest.mark.parametrize(("local", "ties"), [(30, True)])
def test_labels_are_those_of_plain_loops(spark, monkeypatch, local, ties):
    monkeypatch.setattr(density, "LOCAL", local)
    monkeypatch.setattr(pivots, "CELL", 40)
    monkeypatch.setattr(pivots, "PACK", 120)
    x = blobs(3, 240)
    if ties:
        x = np.round(x, 0)  # a lattice: copies and equal distances
    got = {r.id: r.label for r in density.cluster(table(spark, x), 12, 5).collect()}
    want = plain(x, 12, 5)
    assert [got[i] for i in range(len(x))] == want
    assert -1 in want and len(set(want)) > 2


def test_two_thousand_vectors(spark):
    x = blobs(5, 2000, 6, 4)
    got = {r.id: r.label for r in density.cluster(table(spark, x), 25, 10).collect()}
    assert [got[i] for i in range(len(x))] == plain(x, 25, 10)


def test_problems_split_in_halves_have_the_same_outcome(spark, monkeypatch):
    r = np.random.default_rng(7)
    n = 160
    edges = [(int(r.integers(0, i)), i, float(r.integers(1, 40))) for i in range(1, n)]
    tree = spark.createDataFrame(edges, "a long, b long, w double")
    comps = spark.createDataFrame([(i, 0) for i in range(n)], "id long, comp long")

    def outcome():
        points, clusters = density.hierarchy(tree, comps, 6)
        members = {}
        for p in points.collect():
            members.setdefault(p.cluster, set()).add((p.id, p.level))
        key = {c: frozenset(m) for c, m in members.items()}
        return {(key.get(c.cluster), c.bottom, key.get(c.parent), c.top) for c in clusters.collect()}

    whole = outcome()
    monkeypatch.setattr(density, "LOCAL", 16)
    assert outcome() == whole and len(whole) > 5


def test_odd_tables(spark):
    rows = [(1, [0.0]), (2, [0.0]), (3, [0.0, 1.0]), (4, None), (None, [1.0])]
    got = {r.id: r.label for r in density.cluster(spark.createDataFrame(rows, "id long, v array<double>"), 2, 1).collect()}
    assert set(got) == {1, 2, 3}  # a single root is never a cluster
    assert got[3] == -1
    assert density.cluster(spark.createDataFrame([], "id long, v array<double>"), 2, 2).count() == 0


def test_the_largest_component_never_looks(spark, monkeypatch):
    monkeypatch.setattr(pivots, "CELL", 16)
    monkeypatch.setattr(pivots, "PACK", 32)
    r = np.random.default_rng(9)
    x = np.concatenate([r.standard_normal((120, 2)), r.standard_normal((20, 2)) + 60, r.standard_normal((16, 2)) - 90])
    asked, largest, met, searched = [], [], pivots.met, density._searched

    def search(cells, state, *rest):
        largest.append(state.groupBy("comp").count().orderBy("count", "comp", ascending=False).first().comp)
        return searched(cells, state, *rest)

    def meet(asking, *rest):
        if "cut" in asking.columns:
            asked.append({c for row in asking.collect() for c, cut in zip(row.comp, row.cut, strict=True) if cut >= 0})
        return met(asking, *rest)

    monkeypatch.setattr(density, "_searched", search)
    monkeypatch.setattr(pivots, "met", meet)
    got = {r.id: r.label for r in density.cluster(table(spark, x), 10, 5).collect()}
    assert [got[i] for i in range(len(x))] == plain(x, 10, 5)
    assert any(asked) and not any(c in a for c, a in zip(largest, asked, strict=True))

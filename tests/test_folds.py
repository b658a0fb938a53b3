"""Exact stratified folds."""

import collections
import hashlib

from geoaudit.functions import folds


def test_stratified_folds_are_exact(spark):
    y = {i: (None if i % 97 == 0 else int(i % 41 == 0)) for i in range(3000)}
    x = spark.createDataFrame(list(y.items()), "id long, y int")
    order, want = collections.Counter(), {}
    for i in sorted(y, key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i)):
        want[i] = order[y[i]] % 5
        order[y[i]] += 1
    got = folds.stratified_folds(x, 5, "y", "id").collect()
    assert {r.id: r.fold for r in got} == want and len(got) == 3000
    n = collections.Counter((r.y, r.fold) for r in got)
    assert all(max(c) - min(c) <= 1 for c in ([n[k, f] for f in range(5)] for k in (0, 1, None)))

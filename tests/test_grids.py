"""Gathers between grids by hand."""

import math

import pytest

from geoaudit.operators import grids


def test_turned_grids_find_each_other(spark):
    a = 0.3
    known = grids.dimension(spark, [("a", 20, 30, 2.0, 0.0, 100.0, 0.0, -2.0, 50.0), ("b", 6, 5, 3 * math.cos(a), 3 * math.sin(a), 95.0, 3 * math.sin(a), -3 * math.cos(a), 45.0)])
    values = spark.createDataFrame([(r, c, float(100 * r + c)) for r in range(20) for c in range(30) if (r, c) != (3, 1)], "r long, c long, v double")
    got = grids.nearest(grids.cells(known.where("grid = 'b'")), known, "a", values, ["v"]).collect()
    assert len(got) == 30
    for g in got:
        x = 95 + 3 * math.cos(a) * (g.c + 0.5) + 3 * math.sin(a) * (g.r + 0.5)
        y = 45 + 3 * math.sin(a) * (g.c + 0.5) - 3 * math.cos(a) * (g.r + 0.5)
        r, c = math.floor((50 - y) / 2), math.floor((x - 100) / 2)
        inside = 0 <= r < 20 and 0 <= c < 30
        assert (g.x, g.y) == pytest.approx((x, y))
        assert (g.sr, g.sc) == ((r, c) if inside else (None, None))
        assert g.v == (100 * r + c if inside and (r, c) != (3, 1) else None)
    # a grid finds its own cells
    own = grids.nearest(grids.cells(known.where("grid = 'b'")), known, "b", values, ["v"]).collect()
    assert all((g.sr, g.sc) == (g.r, g.c) for g in own)
    with pytest.raises(ValueError, match="inverse"):
        grids.dimension(spark, [("z", 1, 1, 1.0, 2.0, 0.0, 2.0, 4.0, 0.0)])


def test_areas_weigh(spark):
    x = spark.createDataFrame([(0, 0, 1.0), (0, 1, 5.0), (0, 2, None), (1, 0, float("nan"))], "r int, c int, v double")
    got = {(g.r, g.c): (round(g["mean"], 9), round(g.covered, 9)) for g in grids.area_weighted(x, "v", (1.0, 1.5)).collect()}
    assert got == {(0, 0): (round((1 + 0.5 * 5) / 1.5, 9), 1.0), (0, 1): (5.0, round(0.5 / 1.5, 9))}
    fine = {(g.r, g.c): g["mean"] for g in grids.area_weighted(x, "v", (0.5, 0.5)).collect()}
    assert len(fine) == 8 and fine[1, 1] == 1.0 and fine[0, 2] == 5.0


def test_blocks_begin_half_a_stride_in(spark):
    x = spark.createDataFrame([(r, c, float(r)) for r in range(11) for c in range(8)], "r int, c int, v double")
    got = {(g.i, g.j): (g["mean"], g.n) for g in grids.half_stride_means(x, "v", 4, 11, 8).collect()}
    assert got == {(0, 0): (3.5, 16), (1, 0): (7.5, 16)}

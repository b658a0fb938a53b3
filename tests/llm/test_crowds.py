"""Runs of crowded segments are found within a segment's row: no window is dealt out again for them."""

import random

import pytest

from geoaudit.llm import repeats as R
from tests.llm.test_repeats import run, texts, wanted


def test_runs_of_crowded_windows(spark, capsys):
    places = [(1, 1, j) for j in (0, 1, 2, 5, 7, 8)] + [(1, 2, j) for j in (0, 1, 2, 9)] + [(1, 3, 4)]
    shared = {(1, 3, 4), (1, 2, 9)}
    rows = [(h, d, j, 7 if (h, d, j) in shared else j, 0, b"k", d, j) for h, d, j in places] + [(2, 4, j, j, 0, b"m", 4, j) for j in (0, 1, 2, 5, 7, 8)]
    df = spark.createDataFrame(rows, "h long, d long, j long, x long, y long, key binary, doc long, at long")
    got = R._crowds(df, False)
    runs = {(r.h, r.d): sorted((s["at"], s["n"]) for s in r.runs) for r in got.collect()}
    assert runs == {(1, 1): [(0, 3), (5, 1), (7, 2)], (1, 2): [(0, 3), (9, 1)], (1, 3): [(4, 1)], (2, 4): [(0, 3), (5, 1), (7, 2)]}
    got.explain()
    assert "Generate" not in capsys.readouterr().out


def test_few_links_take_no_rounds(spark, monkeypatch):
    from geoaudit.operators import components as C

    links = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (900, 900)]
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    want = {i: 0 for i in range(201)} | {500: 500, 501: 500, 900: 900}
    calls = []
    monkeypatch.setattr(C, "_hang", lambda *a: calls.append(a))
    assert {r.node: r.component for r in C.components(df, few=1000).collect()} == want and not calls


@pytest.mark.parametrize("keep", ["none", "first"])
def test_blocks_of_crowded_windows_are_those_of_plain_loops(spark, monkeypatch, keep):
    monkeypatch.setattr(R, "CROWD", 1)
    monkeypatch.setattr(R, "BLOCKS", (16, 4))
    rows = list(enumerate(texts(6, 80, "ab c")))
    random.shuffle(rows)
    assert run(spark, rows, length=40, gram=9, keep=keep) == wanted(rows, length=40, keep=keep)


def test_a_common_passage_is_not_counted_window_by_window(spark, monkeypatch):
    random.seed(8)
    make = lambda n: "".join(random.choices("abcdefgh", k=n))
    passage, n = make(700), 60
    rows = [(i, make(500) + passage + make(500)) for i in range(n)]
    monkeypatch.setattr(R, "CROWD", 8)
    counted, plain = [], R._crowds
    monkeypatch.setattr(R, "_crowds", lambda windows, first: counted.append(windows.count()) or plain(windows, first))
    assert run(spark, rows, length=400) == wanted(rows, length=400)
    assert 0 < sum(counted) <= 64 * n  # of 301 windows of every text

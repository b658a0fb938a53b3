"""Repeated byte strings against plain loops."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from geoaudit.llm import repeats as R


def plain(rows, length, keep="none"):
    """Spans of each row by a dictionary of all strings."""
    at = defaultdict(list)
    data = [(t or "").encode() for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, hashlib.md5(data[i]).digest()))
    for i in order:
        for p in range(len(data[i]) - length + 1):
            at[data[i][p : p + length]].append((i, p))
    out = []
    for i, x in enumerate(data):
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - length + 1):
            found = at[x[p : p + length]]
            if len(found) > 1 and (keep == "none" or found[0] != (i, p)):
                gone[p : p + length] = True
        out.append([(r["at"], r["at"] + r["n"]) for r in R._runs(gone)])
    return out


def texts(seed, n=60, alphabet="abcd é"):
    random.seed(seed)
    make = lambda k: "".join(random.choices(alphabet, k=k))
    passages = [make(random.choice([30, 41, 60, 200])) for _ in range(5)]
    out = []
    for _ in range(n):
        parts = [make(random.randrange(60))]
        for _ in range(random.randrange(4)):
            parts += [random.choice(passages)[random.randrange(5) :], make(random.randrange(30))]
        out.append("".join(parts))
    return out + [out[0], out[1], out[1], "", None, "a" * 39, "a" * 40, "a" * 41, "a" * 300, "ab" * 200, "xyz" * 100 + passages[0] + "xyz" * 50, " " * 200 + out[2]]


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS at", "3 AS spans", "4 AS doc")
    found = R.repeated(df, **how).collect()
    assert len(found) == len(rows)
    assert found[0].key == 1 and found[0].at == 2 and found[0].doc == 4
    return sorted(((r.doc_id is None, r.doc_id or 0), r.text or "", [tuple(s) for s in r.spans]) for r in found)


def wanted(rows, **how):
    return sorted(((i is None, i or 0), t or "", s) for (i, t), s in zip(rows, plain(rows, **how), strict=True))


@pytest.mark.parametrize("crowd", [1024, 1])
def test_every_copy_goes(spark, monkeypatch, crowd):
    monkeypatch.setattr(R, "CROWD", crowd)
    rows = list(enumerate(texts(1)))
    assert run(spark, rows, length=40, gram=9) == wanted(rows, length=40)


@pytest.mark.parametrize("crowd", [1024, 1])
def test_the_first_copy_stays(spark, monkeypatch, crowd):
    monkeypatch.setattr(R, "CROWD", crowd)
    rows = list(enumerate(texts(2)))
    random.shuffle(rows)
    assert run(spark, rows, length=40, gram=16, keep="first") == wanted(rows, length=40, keep="first")


def test_pieces_and_cells(monkeypatch):
    monkeypatch.setattr(R, "PIECE", 50)
    data = np.frombuffer("".join(t or "" for t in texts(3)).encode(), np.uint8)
    seen = [(a, n) for _, at, ns in R.segments(data, 40, 12) for a, n in zip(at.tolist(), ns.tolist(), strict=True)]
    assert [a for a, _ in seen] == [0, *np.cumsum([n for _, n in seen])[:-1].tolist()]
    assert sum(n for _, n in seen) == len(data) - 39


def test_suffixes_and_factors_are_those_of_plain_loops():
    random.seed(4)
    for length in (8, 9, 16, 23):
        data = np.array(random.choices(b"ab", k=400), np.uint8)
        place = np.array(random.sample(range(1000), 400 - length + 1))
        at = np.arange(400 - length + 1)
        text = data.tobytes()
        same = defaultdict(list)
        for p in at.tolist():
            same[text[p : p + length]].append(place[p])
        order, fresh = R.suffix_order(data, at, length)
        strings = [text[p : p + length] for p in order.tolist()]
        assert strings == sorted(strings) and len(strings) == sum(len(v) for v in same.values() if len(v) > 1)
        assert fresh.tolist() == [i == 0 or strings[i] != strings[i - 1] for i in range(len(strings))]
        earlier, later = R.matches(data, at, place, length)
        assert earlier.tolist() == [min(same[text[p : p + length]]) < place[p] for p in at.tolist()]
        assert later.tolist() == [max(same[text[p : p + length]]) > place[p] for p in at.tolist()]


def test_only_suffixes_with_a_partner_are_put_in_order():
    data = np.frombuffer(b"".join(hashlib.sha256(b"%d" % i).digest() for i in range(200)) + hashlib.sha256(b"7").digest() * 2, np.uint8)
    at = np.arange(len(data) - 39)
    text = data.tobytes()
    twice = [p for p in at.tolist() if text.count(text[p : p + 24]) > 1]
    assert R.alike(data, at, 24).tolist() == twice
    order, _ = R.suffix_order(data, at, 24)
    assert sorted(order.tolist()) == twice
    assert R.suffix_order(data, at[:0], 24)[0].tolist() == []


def test_previous_smaller_places():
    random.seed(5)
    values = np.array([random.randrange(50) for _ in range(500)])
    fresh = np.array([i == 0 or random.random() < 0.05 for i in range(500)])
    want, first = [], 0
    for i in range(500):
        first = i if fresh[i] else first
        want.append(next((j for j in range(i - 1, first - 1, -1) if values[j] < values[i]), -1))
    assert R.nearest(values, fresh).tolist() == want


def test_odd_tables(spark):
    assert run_empty(spark) == 0
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(None, long), (3, long[1000:2000] + "!"), (3, "x" * 1000), (3, "x" * 1000), (None, None), (None, "")]
    assert run(spark, rows, length=400) == wanted(rows, length=400)


def run_empty(spark):
    return R.repeated(spark.createDataFrame([], "doc_id long, text string")).count()

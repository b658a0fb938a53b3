"""Near duplicates of texts and vectors against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from geoaudit.llm import jaccard, neardup
from geoaudit.llm._words import shingle_sets
from geoaudit.operators.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def least(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def texts(seed=1, groups=12):
    random.seed(seed)
    words = ["w%d" % i for i in range(400)]
    passage = random.choices(words, k=60)
    out = []
    for _ in range(groups):
        base = random.choices(words, k=random.choice([5, 9, 30, 80, 200]))
        for _ in range(random.choice([1, 2, 8, 30])):
            x = list(base)
            for _ in range(random.choice([0, 0, 1, 2, 3])):
                x[random.randrange(len(x))] = random.choice(words)
            if random.random() < 0.3:
                x += passage
            out.append(" ".join(x).upper() if random.random() < 0.1 else "  ".join(x))
    return out + ["", "  ", None, "one two", "ONE\ttwo", "one three", "a b c d e", "a b c d f"]


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    links = [(i, j) for k, (i, s) in enumerate(sets) for j, u in sets[:k] if s and u and i != j and 100 * len(s & u) >= 80 * len(s | u)]
    return least({i for i, _ in sets}, links)


def test_shingle_sets_match_words():
    x = texts(2) + ["x" * 10, "é É a b c d", "a\x85b c d e f"]
    assert [len(s) for s in shingle_sets(pa.array(x))] == [len(shingles(t)) for t in x]


def test_join_near_is_exact(spark, monkeypatch):
    for seed, block in ((1, 256), (2, 4)):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        rows = [(i * 3, t) for i, t in enumerate(texts(seed))] + [(None, "some words of no one"), (0, "again another text here")]
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS component_id", "0 AS token").repartition(3)
        got = jaccard.join_near(df).collect()
        assert len(got) == len(rows)
        want = brute(rows)
        assert all(r.component_id == (want[r.doc_id] if r.doc_id is not None else None) for r in got)
        n = sorted((r.doc_id or -1, r.n_shingles) for r in got)
        assert n == sorted((i or -1, len(shingles(t))) for i, t in rows)


def test_words_that_collide_under_polynomials(spark):
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    rows = [(1, f"w x {a} y z"), (2, f"w x {b} y z"), (3, a), (4, b), (5, f"w  x {a} y z")]
    got = {r.doc_id: r.component_id for r in jaccard.join_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_one_hash_that_collides_makes_no_link(spark, monkeypatch):
    """With a first hash that sees only a word's length, the second one still decides."""
    from geoaudit.llm import _words

    plain = _words.span_hashes
    monkeypatch.setattr(_words, "span_hashes", lambda data, x, starts, ends, seed=0: plain(data, x, starts, ends, seed) if seed else _words.mix((ends - starts).astype(np.uint64)))
    random.seed(3)
    sets = [" ".join("".join(random.choice("abc") for _ in range(n)) for n in range(1, 30)) for _ in range(4)]
    table = pa.array(sets)
    first = list(shingle_sets(table))
    assert all((x == first[0]).all() for x in first)
    pairs = list(jaccard.both_sets(table, 5))
    assert len({jaccard.fingerprint(s) for s, _ in pairs}) == 1 and len({jaccard.fingerprint(t) for _, t in pairs}) == 4


@pytest.mark.parametrize("heavy", [4 * jaccard.BLOCK, 10])
def test_hot_passages_of_many_sizes(spark, monkeypatch, heavy):
    """A passage in most of the texts, and copies among them: neither blocks of like sizes nor another order lose a link."""
    if heavy == 10:  # the sketch tells nothing: exact counts put the passage last
        monkeypatch.setattr(jaccard, "HEAVY", heavy)
        monkeypatch.setattr(jaccard, "frequency_classes", lambda known: np.zeros(jaccard.SKETCH, np.uint8))
        seen, plain = [], jaccard.heavy_shingles
        monkeypatch.setattr(jaccard, "heavy_shingles", lambda t, k: seen.append(plain(t, k)) or seen[-1])
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "KEYS", 0)
    monkeypatch.setattr(jaccard, "_SEEDS", jaccard._SEEDS[:0])
    random.seed(11)
    words = ["w%d" % i for i in range(300)]
    passage = random.choices(words, k=40)
    rows = []
    for i in range(120):
        base = passage + random.choices(words, k=random.choice([0, 2, 4, 8, 10, 12, 30]))
        rows.append((len(rows), " ".join(base)))
        if i % 3 == 0:
            base[random.randrange(len(base))] = "other"
            rows.append((len(rows), " ".join(base)))
    got = {r.doc_id: r.component_id for r in jaccard.join_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    if heavy == 10:
        assert len(seen) == 1 and set(next(shingle_sets(pa.array([" ".join(passage)]))).tolist()) <= set(seen[0].tolist())


def test_join_near_of_nothing(spark):
    assert jaccard.join_near(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_traversal_keeps_every_link():
    random.seed(7)
    sets = [np.array(sorted(random.sample(range(1 << 40), n)), np.uint64) for n in [10] * 20 + [40] * 20]
    sets += [np.sort(np.append(s[:-1], np.uint64(3))) for s in sets]
    bits = np.frombuffer(b"".join(map(jaccard._bitmap, sets)), np.uint64).reshape(len(sets), -1)
    tree = jaccard.Tree(np.array([len(s) for s in sets]), bits)
    found = {(min(i, j), max(i, j)) for x, y in jaccard.traverse(tree, tree, 80) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    linked = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if jaccard.links(sets[i], sets[j], 80)}
    assert linked <= found and len(linked) == 40
    one, two = jaccard.Tree(np.array([10]), bits[:1]), jaccard.Tree(np.array([len(s) for s in sets]), bits)
    assert {int(j) for _, y in jaccard.traverse(one, two, 80) for j in y} >= {0, 40}


def test_components(spark):
    random.seed(9)
    links = [(i, i + 1) for i in range(100, 160)] + [(random.randrange(50), random.randrange(50)) for _ in range(30)] + [(7, None), (500, 500), (200, 100)]
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    got = {r.node: r.component for r in components(df).collect()}
    clean = [x for x in links if x[1] is not None]
    assert got == least({n for x in clean for n in x}, clean)
    assert components(df.where("a < 0")).count() == 0


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL", 5)
    monkeypatch.setattr(neardup, "GROUP", 2)
    draw = np.random.default_rng(3)
    rows = []
    for g in range(30):
        base = draw.standard_normal(16)
        for _ in range(draw.choice([1, 2, 12])):
            v = base + draw.standard_normal(16) * draw.choice([0.0, 0.03, 0.2])
            rows.append((len(rows) * 2, [float(np.float32(x)) for x in v], int(g % 3)))
    rows += [(1, None, 1), (3, [], 1), (5, [0.0] * 16, 1), (7, [float("nan")] * 16, 1), (9, rows[0][1], None), (11, [None] + [1.0] * 15, 0), (13, [1.0, 0.0], 0), (15, [2.0, 0.0], 0), (rows[4][0], rows[4][1], rows[4][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS rep", "2 AS n_links").repartition(5)
    got = {r.vec_id: r for r in neardup.near_duplicates(df).collect()}
    ok = {i: (np.array(v) / np.linalg.norm(v), y) for i, v, y in rows if v and y is not None and None not in v and np.isfinite(v).all() and any(v)}
    links = [(i, j) for i, (v, y) in ok.items() for j, (u, z) in ok.items() if i < j and y == z and len(v) == len(u) and v @ u >= 0.98]
    want = least({r[0] for r in rows}, links)
    for i in want:
        assert got[i].component_id == want[i] and got[i].kept == (want[i] == i)
        if i != rows[4][0] and want[i] != want[rows[4][0]]:
            assert got[i].n_links == sum(i in x for x in links)
    assert neardup.near_duplicates(df.where("vec_id < 0")).count() == 0


def hard_vectors(n, planted, dim=64, common=0.95, cosine=0.983, seed=0):
    """Vectors of one label with a mean cosine of ``common``, and planted pairs."""
    draw = np.random.default_rng(seed)
    mean = np.zeros(dim)
    mean[0] = np.sqrt(common)
    x = mean + draw.standard_normal((n, dim)) * np.sqrt((1 - common) / dim)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x[:planted]
    g = draw.standard_normal(y.shape)
    g -= (g * y).sum(1, keepdims=True) * y
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    return np.concatenate([x[planted:], y, cosine * y + np.sqrt(1 - cosine**2) * g]).astype(np.float32)


def recall(spark, x, label=None):
    """Share of directed links found, against brute force in blocks."""
    table = pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": pa.array(np.zeros(len(x), np.int32) if label is None else label)})
    got = neardup.near_duplicates(spark.createDataFrame(table).repartition(8)).toPandas()
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    true = sum(int(((u[i : i + 2048] @ u.T) >= 0.98).sum()) for i in range(0, len(u), 2048)) - len(u)
    found = int(got["n_links"].sum())
    assert found <= true
    return found / true


def test_recall_of_vectors_with_a_common_part(spark):
    assert recall(spark, hard_vectors(5000, 2000)) >= 0.97
    assert recall(spark, hard_vectors(5000, 2000, common=0.0)) >= 0.99


def test_plan_grows_with_rows_and_difficulty():
    assert neardup.plan(500, 0.0, 0.98, 1 << 17) == (2, 1)
    cost = [g * (neardup.SHUFFLE + k) for g, k in (neardup.plan(n, c, 0.98, 1 << 17) for n, c in ((500, 0), (100_000, 0), (10**7, 0), (10**7, 0.9)))]
    assert cost == sorted(cost)


def test_crowd_of_near_copies_is_settled_by_cells(spark, monkeypatch):
    """All pairs of a tight crowd link; none of its vectors need be compared."""
    monkeypatch.setattr(neardup, "CELL", 16)
    draw = np.random.default_rng(5)
    x = (np.eye(32)[0] + draw.standard_normal((300, 32)) * 0.004).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = neardup.near_duplicates(df).collect()
    assert {r.n_links for r in got} == {299} and {r.component_id for r in got} == {0}
    plain, kept = neardup.materialise, []
    monkeypatch.setattr(neardup, "materialise", lambda f, name: kept.append(plain(f, name)) or kept[-1])
    members = df.selectExpr("0L AS component", "vec_id AS rep", "embedding AS v", "1L AS members")
    assert neardup.count_links(members, 0.98).where("n = 299").count() == 300
    assert kept[1].where("links < 0").count() == 0

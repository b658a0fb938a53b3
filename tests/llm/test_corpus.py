"""Decontamination, toxicity, language, licences, sharding, lists and archives."""

import base64
import hashlib
import itertools
import random
import re
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from geoaudit.llm import decontaminate as dec
from geoaudit.llm import language, licenses, sharding, toxicity, url_filters, warc
from geoaudit.session import new_folder


def test_masks_survive_all_substitutions():
    for size in range(dec.SHORTEST, dec.WINDOW + 1):
        allowed = size - -(-dec.PERCENT * size // 100)
        for bad in itertools.combinations(range(size), allowed):
            assert any(all(m[k] == "0" or at + k not in bad for k in range(len(m))) for m in dec.MASKS for at in range(size - len(m) + 1)), (size, bad)


def plain_overlap(text, item):
    """The best overlap by loops over all diagonals and windows."""
    find = lambda x: re.findall(r"[\u3000-\u9fff]|[0-9a-z]+", (x or "").lower())
    t, u = find(text), find(item)
    size, share = min(13, len(u)), 80
    best = None
    for line in range(1 - len(u), len(t)) if u else ():
        lo, hi = max(0, -line), min(len(u), len(t) - line)
        same = [t[line + k] == u[k] for k in range(lo, hi)]
        windows = [w for w in range(len(same) - size + 1) if 100 * sum(same[w : w + size]) >= share * size]
        at = sorted({k for w in windows for k in range(w, w + size) if same[k]})
        if at:
            best = max(best or (0, 0), (len(at), -(line + lo + at[0])))
    return best and (best[0], -best[1])


def test_repetitive_documents_are_verified_once_per_item(spark):
    docs = spark.createDataFrame([(1, "same " * 20_000), (2, "other words")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, "same " * 10) for i in range(4)], "item_id long, text string")
    found = dec.overlaps(docs, bench)
    began = time.perf_counter()
    got = found.collect()
    assert len(got) == 4 and all(r.agreeing == 10 and r.start_word == 0 for r in got)
    assert time.perf_counter() - began < 20


def test_a_phrase_that_all_share_brings_nobody_together(spark):
    random.seed(3)
    words = ["u%d" % i for i in range(5000)]
    opening = "which of the following is the best answer here".split()
    make = lambda n: " ".join(opening + random.choices(words, k=n))
    items = [(i, make(random.choice([3, 12, 30]))) for i in range(1500)]
    rows = [(d, make(60)) for d in range(1500)]
    for d in range(0, 40):  # some documents do hold an item
        rows[d] = (d, " ".join(random.choices(words, k=20)) + " " + items[7 * d][1])
    began = time.perf_counter()
    got = {(r.doc_id, r.item_id) for r in dec.overlaps(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), spark.createDataFrame(items, "item_id long, text string")).collect()}
    took = time.perf_counter() - began
    assert got >= {(d, 7 * d) for d in range(40)}
    assert all(plain_overlap(rows[d][1], items[i][1]) for d, i in got)
    # 9 of 12 words: three quarters agree with the shortest items, which is too few
    assert took < 60


def test_full_masks_find_what_overlaps(spark, monkeypatch):
    monkeypatch.setattr(dec, "HEAVY", 0)
    test_overlaps(spark)


def test_full_masks_agree_where_windows_overlap():
    random.seed(6)
    for size in range(dec.SHORTEST, dec.WINDOW + 1):
        a = np.array(random.sample(range(1 << 40), size), np.uint64)
        for changed in (0, size - -(-80 * size // 100), size - -(-80 * size // 100) + 1):
            b = a.copy()
            b[random.sample(range(size), changed)] += np.uint64(1)
            same = np.intersect1d(dec.full_keys(a, np.array([0]), size), dec.full_keys(b, np.array([0]), size))
            assert (len(same) > 0) == (100 * (size - changed) >= 80 * size)


def test_overlaps(spark):
    random.seed(1)
    words = ["v%d" % i for i in range(500)]
    items = [(i, " ".join(random.choices(words, k=n))) for i, n in enumerate([8, 13, 20, 40, 3, 6])] + [(90, None), (None, "a b c d e f g h i j k"), (91, ""), (92, "漢字仮名交じり文の長い例文です。これは"), (93, "short Han 漢字")]
    rows, want = [], {}
    for d in range(300):
        text = random.choices(words, k=random.randint(0, 150))
        if d % 3 == 0:
            i, item = items[d % 4][0], items[d % 4][1].split()
            lo = random.randint(0, max(0, len(item) - 13))
            part = item[lo : lo + max(13, random.randint(0, len(item)))]
            size = min(13, len(item))
            for at in random.sample(range(size), random.choice([0, size - -(-80 * size // 100)])):
                part[at] = "changed"
            at = random.randint(0, len(text))
            text[at:at] = [p.upper() + random.choice(["", ",", "."]) for p in part]
            want[d] = i
        rows.append((d, " ".join(text)))
    rows += [(1000, None), (1001, ""), (None, items[3][1]), rows[0], (1002, items[4][1].upper()), (1003, " ".join(items[5][1].split()[:4])), (1004, "x " + items[5][1] + " y"), (1005, "前置き" + "漢字仮名交じり文の長い例文です。これは"[:16] + "別"), (1006, "a short han 漢字 b"), (1007, "short han 漢")]
    rows.append((1008, " ".join(random.choices(words[:4], k=30_000) + items[3][1].split()[5:30])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "'h' AS hash").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dec.overlaps(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= set(want.items()) | {(1002, 4), (1004, 5), (1005, 92), (1006, 93), (1008, 3)}
    brute = {(d, i): x for d, t in dict(rows).items() for i, u in items if d is not None and i is not None and d != 1008 and (x := plain_overlap(t, u))}
    assert {(r.doc_id, r.item_id): (r.agreeing, r.start_word) for r in got if r.doc_id != 1008} == brute
    assert all(r.end_word - r.start_word >= r.agreeing for r in got)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    assert dec.overlaps(docs.where("doc_id < 0"), bench).count() == 0
    assert dec.overlaps(docs, bench.where("item_id < 0")).count() == 0


def toxic_rows(n=900):
    random.seed(2)
    plain, insult, group = ["p%d" % i for i in range(60)], ["insulta", "insultb"], ["groupa", "groupb"]
    out = []
    for d in range(n):
        kind = d % 4
        text = random.choices(plain, k=20) + [random.choice(insult)] * (kind in (1, 3)) + [random.choice(group)] * (kind in (2, 3))
        random.shuffle(text)
        out.append((d, " ".join(text), int(kind == 3)))
    return out


def test_machine_learns_pairs_that_no_linear_model_can(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([r[:2] for r in rows] + [(5000, None), (5001, ""), (None, "x")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(7, None), (None, 1), (99999, 1)], "doc_id long, toxic int")
    machine = toxicity.learn(docs, labels.where(~toxicity.held_out()))
    got = {r.doc_id: r for r in toxicity.score(docs, machine).collect()}
    truth = {r[0]: r[2] for r in rows}
    out = spark.createDataFrame([(d,) for d in truth], "doc_id long").where(toxicity.held_out()).collect()
    right = np.mean([got[r.doc_id].predicted == truth[r.doc_id] for r in out])
    assert right > 0.97
    assert got[5000].score == got[5001].score and 0 <= got[5000].score < 0.5
    assert toxicity.score(docs.where("doc_id < 0"), machine).count() == 0


def test_machine_learns_pairs_without_any_say_of_their_own(spark):
    """The label is that both terms are there or neither: no term alone tells anything."""
    random.seed(21)
    plain, rows = ["p%d" % i for i in range(60)], []
    for d in range(1200):
        a, b = random.random() < 0.5, random.random() < 0.5
        text = random.choices(plain, k=12) + ["alpha"] * a + ["beta"] * b
        random.shuffle(text)
        rows.append((d, " ".join(text), int(a == b)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").selectExpr("*", "1 AS `a.b`", "2 AS Predicted")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    machine = toxicity.learn(docs, labels.where(~toxicity.held_out()))
    got = toxicity.score(docs, machine).withColumn("out", toxicity.held_out()).where("out").collect()
    assert np.mean([r.predicted == rows[r.doc_id][2] for r in got]) > 0.95
    assert got[0].asDict().keys() == {"doc_id", "text", "a.b", "score", "predicted", "out"}


def test_sample_is_bounded_by_terms(spark):
    docs = spark.createDataFrame([(d, " ".join(f"w{d}x{i}" for i in range(50))) for d in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2) for d in range(40)], "doc_id long, toxic int")
    few = toxicity.learn(docs, labels, most_terms=600)
    assert 0 < (few.index >= 0).sum() <= 600 < (toxicity.learn(docs, labels).index >= 0).sum()


def test_machine_score_is_the_formula():
    m = toxicity.Machine(0.3, np.array([1.0, -2, 0.5]), np.random.default_rng(0).standard_normal((3, 4)), np.zeros(1))
    raw = m.raw(2, np.array([0, 0, 0]), np.array([0, 1, 2]))
    v = m.factors
    assert raw[0] == pytest.approx(0.3 - 0.5 + v[0] @ v[1] + v[0] @ v[2] + v[1] @ v[2])
    assert raw[1] == 0.3


def test_one_label_or_none(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    for y, p in ((0, 0), (1, 1)):
        m = toxicity.learn(docs, spark.createDataFrame([(1, y)], "doc_id long, toxic int"))
        assert [r.predicted for r in toxicity.score(docs, m).collect()] == [p, p]
    m = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.predicted for r in toxicity.score(docs, m).collect()] == [0, 0]


def test_languages(spark):
    random.seed(4)
    alphabets = {"xx": "abcde ", "yy": "fghij ", "zz": "äöüß "}
    make = lambda k, n: "".join(random.choice(alphabets[k]) for _ in range(n))
    rows = [(i, make(k, 120), k) for i, k in enumerate(list(alphabets) * 40)]
    odd = [(900, None, "xx"), (901, "", "xx"), (902, "12 …£ 3!", "yy"), (903, make("xx", 300) + " " + make("yy", 100), None), (904, "漢字 x", None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("clash"))
    model = language.learn(df.where(~language.held_out()))
    got = {r.doc_id: r for r in language.predict(df, model).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].lang_set == ["xx", "yy"] and 0.6 < got[903].score < 0.9
    assert got[904].lang_pred in alphabets
    assert all(r.lang_pred == "und" for r in language.predict(df, language.learn(df.where("false"))).collect())
    assert language.predict(df.where("false"), model).count() == 0


def test_sets_of_many_languages(spark):
    """Five languages in one text are all found; repeated rows agree; names clash."""
    random.seed(14)
    alphabets = {k: "".join(chr(97 + 5 * i + j) for j in range(5)) + " " for i, k in enumerate("abcde")}
    make = lambda k, n: "".join(random.choice(alphabets[k]) for _ in range(n))
    rows = [(i, make(k, 400), k) for i, k in enumerate(list(alphabets) * 20)]
    long_one = " ".join(make(k, 60_000) for k in "abcd")
    mixed = [(900, " ".join(make(k, 500) for k in "abcde"), None), (901, " ".join(make(k, 500) for k in "bd"), None), (900, " ".join(make(k, 500) for k in "abcde"), None), (902, long_one, None)]
    df = spark.createDataFrame(rows + mixed + [(None, "abc", None)], "doc_id long, text string, lang string").selectExpr("*", "1 AS Score", "2 AS `a.b`")
    got = language.predict(df, language.learn(df)).collect()
    assert len(got) == len(rows) + 5 and got[0].asDict().keys() == {"doc_id", "text", "lang", "a.b", "lang_pred", "score", "lang_set"}
    assert all(sorted(r.lang_set) == list("abcde") for r in got if r.doc_id == 900)
    assert [sorted(r.lang_set) for r in got if r.doc_id in (901, 902)] == [["b", "d"], list("abcd")]


def test_mixture_is_plain_expectation_maximisation():
    draw = np.random.default_rng(2)
    likelihood, words = draw.random((50, 3)), np.array([20, 30])
    share, value = language.mixtures(likelihood, np.array([0, 20]), words, np.array([[1.0, 1, 1], [1, 0, 1]]))
    for t, (lo, hi, start) in enumerate(((0, 20, [1 / 3] * 3), (20, 50, [0.5, 0, 0.5]))):
        p = list(start)
        for _ in range(language.ROUNDS):
            parts = [[p[k] * row[k] / sum(p[m] * row[m] for m in range(3)) for k in range(3)] for row in likelihood[lo:hi]]
            p = [sum(x[k] for x in parts) / (hi - lo) for k in range(3)]
        assert share[t] == pytest.approx(p)
        assert value[t] == pytest.approx(sum(np.log(sum(p[k] * row[k] for k in range(3))) for row in likelihood[lo:hi]))


def test_licences(spark):
    rows = [
        ("a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        ("a/b/c/x.py", "print(1)"),
        ("a/b/LICENSE", "Released under the MIT License."),
        ("a/b/y.py", "code\nLicensed under the Apache License, Version 2.0.\nmore code here"),
        ("top.py", "nothing of the kind"),
        (None, "Licensed under CC BY-NC 4.0."),
        (None, None),
        ("a/b/COPYING", "Licensed under CC BY-NC 4.0.\n"),
        ("a/b/y.py", ""),
    ]
    df = spark.createDataFrame(rows, "path string, text string").withColumn("license", F.lit("clash"))
    got = licenses.inherit(licenses.scan(df), F.col("path").rlike("(^|/)(LICENSE|COPYING)$")).collect()
    assert len(got) == len(rows)
    found = {(r.path, r.text): (r.own_license, r.license, r.inherited_from) for r in got}
    assert found["a/LICENSE", rows[0][1]][:2] == ("MIT", "MIT")
    assert found["a/b/c/x.py", "print(1)"] == (None, "CC-BY-NC-4.0", "a/b")
    assert found["a/b/y.py", rows[3][1]] == ("Apache-2.0", "Apache-2.0", None)
    assert found["a/b/y.py", ""] == (None, "CC-BY-NC-4.0", "a/b")
    assert found["top.py", rows[4][1]] == (None, None, None)
    assert found[None, rows[5][1]] == ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None)
    assert found[None, None] == (None, None, None)
    assert licenses.scan(df.where("false")).count() == 0


PACKAGES = Path("/opt/py313/lib/python3.13/site-packages")


@pytest.mark.skipif(not PACKAGES.exists(), reason="needs the licence files of installed packages")
def test_licence_files_of_installed_packages(spark):
    files = {"requests-*/licenses/LICENSE": "Apache-2.0", "packaging-*/licenses/LICENSE.APACHE": "Apache-2.0", "packaging-*/licenses/LICENSE.BSD": "BSD-2-Clause", "numpy-*/LICENSE.txt": "BSD-3-Clause", "pyarrow-*/licenses/LICENSE.txt": "Apache-2.0", "typing_extensions-*/licenses/LICENSE": "PSF-2.0", "pytest-*/licenses/LICENSE": "MIT", "pandas-*/LICENSE": "BSD-3-Clause"}
    rows = [(pattern, f.read_text(encoding="utf-8", errors="replace")) for pattern in files for f in list(PACKAGES.glob(pattern))[:1]]
    rows += [(f"whole {name}", text) for name, text in licenses.templates() if len(text) > 2000]
    filler = [(f"plain {i}", " ".join(random.choices(["copyright", "the", "of", "and", "software", "text", "words", "other", "things"], k=50))) for i in range(60)]
    df = spark.createDataFrame(rows + filler, "path string, text string").selectExpr("*", "'x' AS dir", "1 AS `up.of`", "2 AS row")
    got = {r.path: r for r in licenses.scan(df).collect()}
    assert {p: got[p].own_license for p, _ in rows if p in files} == {p: files[p] for p, _ in rows if p in files}
    assert all(got[p].own_license == p.removeprefix("whole ") for p, _ in rows if p.startswith("whole"))
    assert {"BSD-3-Clause", "GPL-3.0"} <= set(got["numpy-*/LICENSE.txt"].all_licenses)
    assert all(got[p].own_license is None for p, _ in filler)
    kept = licenses.inherit(licenses.scan(df), F.lit(False))
    assert kept.columns == [*df.columns, "own_license", "similarity", "grain", "all_licenses", "license", "inherited_from"]
    assert {r.dir for r in kept.collect()} == {"x"}


def test_licences_are_plain_cosines(spark):
    """Cosines of lines, paragraphs and wholes by dictionaries, with document frequencies counted by loops."""
    random.seed(31)
    pool = "released under the mit license this program is free software of and any".split() + ["odd%d" % i for i in range(8)]
    texts = ["\n".join(" ".join(random.choices(pool, k=random.randint(0, 7))) + random.choice(["", "\n"]) for _ in range(random.randint(0, 6))) for _ in range(60)] + ["Released under the MIT License.", None]
    find = lambda x: re.findall(r"[0-9a-z]+", (x or "").lower())
    df = Counter(w for t in texts for w in set(find(t)))
    weigh = lambda ws: {w: (1 + np.log(c)) * (np.log((1 + len(texts)) / (1 + df[w])) + 1) for w, c in Counter(ws).items()}
    norm = lambda d: np.sqrt(sum(v * v for v in d.values())) or 1.0
    known = [weigh(find(t)) for _, t in licenses.templates()]

    def near(segment):
        d = weigh(find(segment))
        return max(sum(d[w] * t.get(w, 0) for w in d) / norm(d) / norm(t) for t in known)

    got = {r.i: r.similarity for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()}
    for i, text in enumerate(texts):
        whole, parts = near(text), [near(x) for x in (text or "").split("\n") + re.split(r"\n[ \t]*\n", text or "")]
        if max([whole, *parts]) < licenses.WHOLE:
            assert got[i] == pytest.approx(max([whole, *parts]), abs=1e-9)
        else:
            assert got[i] >= licenses.WHOLE - 1e-9


def test_licence_cosine_is_the_formula():
    n, f = 10, np.arange(len(licenses.vocabulary()[0])) % 7
    s = licenses.Scanner(n, f)
    text = "Released under under the MIT License by nobody"
    w = next(licenses.words(pa.array([text]), licenses.ALNUM))
    value, which, _, _ = s.best(w)
    word = lambda x: next(licenses.words(pa.array([x]), licenses.ALNUM)).hashes[0]
    idf = lambda x: s.idf[licenses.numbered(np.array([word(x)]), s.known)[0]]
    doc = {x: idf(x) * (1 + np.log(c)) for x, c in (("released", 1), ("under", 2), ("the", 1), ("mit", 1), ("license", 1))}
    norm = np.sqrt(sum(v**2 for v in doc.values()) + s.other**2 * (1 if licenses.numbered(np.array([word("by")]), s.known)[0] < 0 else 0) + (0 if licenses.numbered(np.array([word("by")]), s.known)[0] < 0 else idf("by") ** 2) + s.other**2)
    t = {x: idf(x) for x in ("released", "under", "the", "mit", "license")}
    want = sum(doc[x] * t[x] for x in t) / norm / np.sqrt(sum(v**2 for v in t.values()))
    assert s.names[which[0]] == "MIT" and value[0] == pytest.approx(want)


def test_matrix_sums_and_mean():
    rows, sizes = np.array([5, 0, 7, 9]), sharding.shard_sizes(21, 4)
    drawn = [sharding.matrix(rows, sizes, s) for s in range(400)]
    assert all((m.sum(1) == rows).all() and (m.sum(0) == sizes).all() for m in drawn)
    assert np.allclose(np.mean(drawn, 0), np.outer(rows, sizes) / 21, atol=0.2)


def test_shards(spark):
    rows = [(i, f"t{i}") for i in range(1000)] + [(5, "t5")] * 30 + [(None, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("clash"))
    for key in ("doc_id", None):
        got = sharding.shard(df, 7, seed=3, key=key).collect()
        assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted((a or -1, b or "") for a, b in rows)
        sizes = [sorted(r.slot for r in got if r.shard == s) for s in range(7)]
        assert all(s == list(range(len(s))) for s in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    again = sharding.shard(df, 7, seed=3).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert sharding.shard(df.where("false"), 7).count() == 0


def test_shards_are_dealt_by_the_matrix(spark):
    """A plain dealing by the same partitions, orders and counts gives every row the same shard."""
    df = spark.range(5000).selectExpr("id AS doc_id", "cast(id % 7 AS string) AS p", "id AS r", "'x' AS c", "id AS row", "1 AS `a.b`")
    got = sharding.shard(df, 5, seed=9, key="doc_id").collect()
    assert got[0].asDict().keys() == {"doc_id", "p", "r", "c", "row", "a.b", "shard", "slot"}
    assert all(r.r == r.doc_id == r.row and r.p == str(r.doc_id % 7) for r in got)
    parts = -(-5000 // sharding.ROWS_A_CELL)
    keys = df.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(parts)).alias("v"), F.xxhash64("doc_id", F.lit(10)).alias("o")).collect()
    piles = [[r.doc_id for r in sorted(keys, key=lambda r: r.o) if r.v == v] for v in range(parts)]
    drawn = sharding.matrix(np.array([len(p) for p in piles]), sharding.shard_sizes(5000, 5), 9)
    want = {}
    for pile, counts in zip(piles, drawn, strict=True):
        for s, n in enumerate(counts.tolist()):
            want |= dict.fromkeys(pile[:n], s)
            pile = pile[n:]
    assert {r.doc_id: r.shard for r in got} == want


def test_shards_are_uniform(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_A_CELL", 16)
    df = spark.range(400).withColumnRenamed("id", "doc_id")
    hits = np.zeros((4, 4))
    for seed in range(6):
        for r in sharding.shard(df, 4, seed=seed, key="doc_id").collect():
            hits[r.doc_id // 100, r.shard] += 1
    assert (abs(hits - 150) < 45).all()


def test_lists(spark):
    entries = [("l", "Bad.example", "add", "2024-01-05"), ("l", "bad.example", "remove", "2024-02-01"), ("l", "bad.example", "add", "2024-03-01"), ("l", "bad.example", "add", "2024-03-05"), ("m", "x.org/a/b", "add", "2024-01-01"), ("m", None, "add", "2024-01-01"), ("m", "org", "add", None), ("n", "same.net", "add", "2024-01-01"), ("n", "same.net", "remove", "2024-01-01")]
    e = spark.createDataFrame(entries, "list_name string, pattern string, action string, d string").select("list_name", "pattern", "action", F.to_timestamp("d").alias("at"))
    asked = [("http://www.bad.example/p", "2024-01-05", 1), ("http://u@bad.example:80", "2024-02-01", 0), ("https://BAD.example./", "2024-03-02", 1), ("http://notbad.example/", "2024-01-06", 0), ("http://x.org/A/b/c?q", "2024-05-01", 1), ("http://x.org/a/bc", "2024-05-01", 0), (None, "2024-05-01", 0), ("no url", "2024-05-01", 0), ("http://bad.example/", None, 0), ("http://same.net/", "2024-06-01", 0), ("http://www.bad.example/p", "2024-01-05", 1)]
    c = spark.createDataFrame([(i if i < 10 else 0, u, t) for i, (u, t, _) in enumerate(asked)], "k long, url string, t string").select("k", "url", F.to_timestamp("t").alias("fetched"), F.lit("clash").alias("rule"))
    got = url_filters.filter_urls(c, e, "k").orderBy("k").collect()
    assert len(got) == len(asked)
    want = {i if i < 10 else 0: w for i, (_, _, w) in enumerate(asked)}
    assert {r.k: r.n_active for r in got} == want and all(r.allowed == (r.n_active == 0) for r in got)
    assert {r.rule for r in got} == {None, "bad.example", "x.org/a/b"}
    assert url_filters.filter_urls(c, e.where("false"), "k").where("allowed").count() == len(asked)
    plan = url_filters.filter_urls(c, e, "k")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_archive(spark):
    random.seed(8)
    pages = [(i, f"http://h{i % 7}.example.com/p/{i % 50}?q=é {i % 3}", random.choice([None, "", "same", f"own {i}\r\n\r\n", "é" * 3000])) for i in range(1500)]
    pages += [(3000, None, "x\r\n\r\ny"), (3001, "odd\turl\nhere", "z"), (None, "http://h1.example.com/", "of no one"), (None, "http://h1.example.com/2", "own 1")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    folder = new_folder(spark, "warc")
    parts = warc.write_archive(df, folder)
    back = warc.read_captures(df, folder, parts).collect()
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    assert len(back) == len(pages)
    want = {}
    for i, _, h in pages:
        if i is not None:
            raw = (h or "").encode()
            want[i] = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""], raw)
    for r in back:
        if r.page_id is not None:
            assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == want[r.page_id][:4]
            assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == want[r.page_id][4]
    index = warc.Index(folder, [tuple(r) for r in parts.orderBy("first_key", "first_id").collect()])
    key = df.where("page_id = 10").select(warc.url_key(F.col("url"))).first()[0]
    same = df.where(warc.url_key(F.col("url")) == key).count()
    assert len(list(index.find(key))) == same > 1
    assert list(index.find("nowhere)/")) == [] and list(index.find("zz")) == []
    none = warc.write_archive(df.where("false"), folder)
    assert none.count() == 0 and warc.read_captures(df, folder, none).count() == 0
    small = warc.read_captures(df, folder, warc.write_archive(df, folder, least=100))
    assert small.where("record_type = 'revisit'").agg(F.min("payload_bytes")).first()[0] == 6000


def test_machine_is_not_fitted_on_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(d, "good day" if d % 2 else "bad night") for d in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2) for d in range(40)], "doc_id long, toxic int")

    fit = toxicity.fit

    def watched(sample):
        assert TaskContext.get() is not None, "the driver got the sample's terms"
        return fit(sample)

    monkeypatch.setattr(toxicity, "fit", watched)
    machine = toxicity.learn(docs, labels)
    assert [r.predicted for r in toxicity.score(docs, machine).orderBy("doc_id").collect()] == [d % 2 for d in range(40)]

"""Licence headers on tables of any size, further licences, and deep folders."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoaudit.llm import licenses


def test_common_words_weigh_little(spark):
    text = "Released under the MIT License today"
    docs = [("filler today and more of it %d" % i,) for i in range(3000)] + [(text,)] * 30
    df = spark.createDataFrame(docs, "text string").repartition(3)
    n, known, sketch = licenses.document_frequencies(df, "text")
    word = lambda x: next(licenses.words(pa.array([x]), licenses.ALNUM)).hashes
    count = lambda x: min(sketch[a[0]] for a in licenses.slots(word(x)))
    assert n == 3030 and (count("today"), count("filler"), count("2999")) == (3030, 3000, 1)
    assert known[licenses.numbered(word("mit"), licenses.vocabulary()[0])[0]] == 30
    best = lambda *a: licenses.Scanner(*a).best(next(licenses.words(pa.array([text]), licenses.ALNUM)))[0][0]
    assert best(n, known, sketch) > 0.9 > best(n, known)
    # the same shares of texts a hundred thousand times over
    big = 100_000
    assert best(n * big, known * big, sketch * big) == pytest.approx(best(n, known, sketch), abs=0.01)
    assert best(n * big, known * big) < licenses.LEAST


def test_more_licences(spark):
    gpl = "Copyright (C) 2010 A. Person\n\nThis program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.\n\nint main() {}"
    bsd = "Copyright (c) 2011, Some One\nAll rights reserved.\n\n" + licenses._BSD
    rows = [
        (gpl, "GPL-2.0-or-later"), (gpl.replace("version 2", "version 3"), "GPL-3.0"), (gpl.replace("GNU General", "GNU Affero General").replace("version 2", "version 3"), "AGPL-3.0"), (bsd.format(""), "BSD-2-Clause"),
        (bsd.format("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"), "BSD-3-Clause"),
        ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/", "EPL-2.0"), ("nothing of the kind", None),
    ]
    got = {r.text: r.own_license for r in licenses.scan(spark.createDataFrame([r[:1] for r in rows], "text string")).collect()}
    assert [got[t] for t, _ in rows] == [k for _, k in rows]


def test_deep_folders_inherit(spark):
    deep = "top/" + "/".join(f"d{i}" for i in range(60)) + "/x.py"
    df = spark.createDataFrame([("top/LICENSE", "MIT"), (deep, None)], "path string, own_license string")
    got = {r.path: (r.license, r.inherited_from) for r in licenses.inherit(df, F.col("path").endswith("LICENSE")).collect()}
    assert got[deep] == ("MIT", "top")

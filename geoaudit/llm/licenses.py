"""Licence scan: TF-IDF cosine to templates, then inheritance from directories.

Every whole text is compared with licence templates at three grains: each line,
each paragraph (lines up to a blank one) and the whole text; so a one-line
header, a header of several lines and a licence file are all met.  The measure is
the cosine of sparse TF-IDF vectors of words; document frequencies are counted over
all texts, exactly for the templates' words and by a sketch of fixed size for all
others (the lesser of two hashed counts, so never too low).

Templates are the wordings below and the whole licence texts in ``licence_texts``.
A whole text that is a template's but for names (``ENTIRE``) has its licence, even if a
sentence of it that several licences share is closer to another one's.  Else the
first line or paragraph that is close to one (``WHOLE``) decides (a licence file names its own
licence before those of what it bundles), else the closest one.  All licences that
any line, paragraph or the whole reaches are listed as well.

A file whose own best cosine reaches ``LEAST`` has that licence.  A file without
one inherits from the nearest ancestor directory that has a licence file: every
path is joined, by an equi-join, with each of its ancestors, and the deepest match
wins (of several licence files in one directory the one with the least path).

Defined results: null or empty texts have no own licence; a null path has no
directory and inherits nothing; ties between templates go to the first licence in
order; repeated rows are scanned one by one; a very long text is scanned by itself,
whole; an empty table gives an empty result.  Other columns pass through, whatever
their names; those named like the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoaudit.llm._frames import append, col
from geoaudit.llm._words import ALNUM, U, Words, mix, words
from geoaudit.session import materialise, table

#: Least cosine of a licence.
LEAST = 0.6
#: Cosine from which a whole text is a licence's text, and from which the first line or paragraph decides.
ENTIRE = 0.95
WHOLE = 0.8
#: Counts in each half of the sketch.
SKETCH = 1 << 19
#: Wordings that several templates share.
_NO_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details. You should have received a copy of the {0} along with this program"
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT = 'MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = 'ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
#: Licences and the wordings by which files name them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain worldwide under CC0 1.0."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("AGPL-3.0", _GNU.format("GNU Affero General Public License", 3)),
    ("AGPL-3.0", _GNU.format("GNU Affero General Public License", 3) + " " + _NO_WARRANTY.format("GNU Affero General Public License")),
    ("BSD-2-Clause", _BSD.format("")),
    ("BSD-3-Clause", _BSD.format("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ")),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0-or-later", _GNU.format("GNU General Public License", 2)),
    ("GPL-2.0-or-later", _GNU.format("GNU General Public License", 2) + " " + _NO_WARRANTY.format("GNU General Public License")),
    ("GPL-3.0", _GNU.format("GNU General Public License", 3) + " " + _NO_WARRANTY.format("GNU General Public License")),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("PSF-2.0", 'PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2 1. This LICENSE AGREEMENT is between the Python Software Foundation ("PSF"), and the Individual or Organization ("Licensee") accessing and otherwise using this software ("Python") in source or binary form and its associated documentation.'),
    ("MIT", _MIT),
    ("ISC", _ISC),
]


@lru_cache(1)
def templates() -> list[tuple[str, str]]:
    """Licences and wordings: TEMPLATES and the whole texts of the folder ``licence_texts``."""
    files = sorted((f for f in resources.files(__package__).joinpath("licence_texts").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    return TEMPLATES + [(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in files]


def vocabulary() -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Sorted hashes of the templates' words, and each template as (word numbers, counts)."""
    hashes = [np.concatenate([w.hashes for w in words(pa.array([t]), ALNUM)]) for _, t in templates()]
    known = np.unique(np.concatenate(hashes))
    return known, [np.unique(np.searchsorted(known, h), return_counts=True) for h in hashes]


def numbered(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The number of each word in the vocabulary, -1 where it has none."""
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, -1)


def slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each word in the sketch."""
    x = mix(h.astype(U))
    return (x & U(SKETCH - 1)).astype(np.int64), SKETCH + ((x >> U(32)) & U(SKETCH - 1)).astype(np.int64)


def document_frequencies(docs: DataFrame, text: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of texts, in how many of them each template word occurs, and a sketch of that for all other words."""
    known = vocabulary()[0]
    size = len(known) + 2 * SKETCH + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total[-1] += b.num_rows
            for w in words(b.column(0), ALNUM):
                # a word of a text once, told by one hash of both
                _, first = np.unique(mix(w.hashes.astype(U) + mix(w.rows.astype(U) + U(1))), return_index=True)
                h = w.hashes[first]
                n = numbered(h, known)
                np.add.at(total, n[n >= 0], 1)
                for at in slots(h[n < 0]):
                    np.add.at(total, len(known) + at, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["word", "n"])

    rows = docs.select(col(text)).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()  # of the sketch's fixed size at most
    total = np.zeros(size, np.int64)
    total[rows.column("word").to_numpy()] = rows.column("n").to_numpy()
    return int(total[-1]), total[: len(known)], total[len(known) : -1]


class Scanner:
    """Cosines of segments of texts to all templates."""

    def __init__(self, n: int, frequency: np.ndarray, sketch: np.ndarray | None = None):
        self.known, counts = vocabulary()
        self.names = [name for name, _ in templates()]
        self.idf = np.log((1.0 + n) / (1.0 + frequency)) + 1
        self.n, self.sketch = n, sketch
        self.other = float(np.log(1.0 + n) + 1)  # words that no text has
        self.templates = np.zeros((len(self.known), len(self.names)))
        for k, (word, count) in enumerate(counts):
            weight = (1 + np.log(count)) * self.idf[word]
            self.templates[word, k] = weight / np.sqrt((weight**2).sum())

    def rarity(self, h: np.ndarray) -> np.ndarray:
        """Inverse document frequencies of words that no template has."""
        if self.sketch is None:
            return np.full(len(h), self.other)
        a, b = slots(h)
        return np.log((1.0 + self.n) / (1.0 + np.minimum(self.sketch[a], self.sketch[b]))) + 1

    def cosines(self, w: Words, segment: np.ndarray, n: int) -> np.ndarray:
        """Cosines, segments x templates; ``segment`` numbers that of each word."""
        h = w.hashes
        order = np.lexsort((h, segment))
        s, h = segment[order], h[order]
        first = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (h[1:] != h[:-1]))) if len(s) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(s)))
        s, h = s[first], h[first]
        number = numbered(h, self.known)
        weight = self.idf[number]
        weight[number < 0] = self.rarity(h[number < 0])
        weight *= 1 + np.log(times)
        norm = np.sqrt(np.bincount(s, weight**2, n))
        hit = number >= 0
        out = np.zeros((n, len(self.names)))
        for k in range(len(self.names)):
            out[:, k] = np.bincount(s[hit], weight[hit] * self.templates[number[hit], k], n)
        return out / np.maximum(norm, 1e-12)[:, None]

    def best(self, w: Words, least: float = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text of a chunk its deciding cosine, the template's number, and the grain (0 line, 1 paragraph, 2 whole).

        And the ``(text, template)`` pairs of all segments' best templates that reach ``least``.
        """
        n = w.last - w.first
        top, which, grain = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        if not len(w.starts):
            return top, which, grain, np.zeros((0, 2), np.int64)
        rows = w.rows
        line = np.append(0, np.cumsum(w.data == 10))[w.starts]
        # a paragraph ends at a line break that only blanks separate from the next one
        breaks = np.flatnonzero(w.data == 10)
        solid = np.append(0, np.cumsum((w.data != 10) & (w.data != 13) & (w.data != 32) & (w.data != 9)))
        ends = breaks[1:][solid[breaks[1:]] == solid[breaks[:-1]]]
        paragraph = np.searchsorted(ends, w.starts)
        found = []  # (row, first word, -cosine, grain, template) of each segment
        for g, part in enumerate((line, paragraph, np.zeros(len(rows), np.int64))):
            key = rows * (int(part.max()) + 1) + part
            kinds, start, segment = np.unique(key, return_index=True, return_inverse=True)
            cos = self.cosines(w, segment, len(kinds))
            found.append(np.stack([kinds // (int(part.max()) + 1), start, -cos.max(1), np.full(len(kinds), g), cos.argmax(1)], 1))
        each = np.concatenate(found)
        row, strong = each[:, 0], -each[:, 2] >= WHOLE
        # the whole if it is close; else the first close segment (the closest of those); else the closest (the finer of equal ones)
        rank = np.where((each[:, 3] == 2) & (-each[:, 2] >= ENTIRE), 0, np.where(strong & (each[:, 3] < 2), 1, 2))
        order = np.lexsort((each[:, 3], np.round(each[:, 2], 9), np.where(rank == 1, each[:, 1], 0), rank, row))
        first = order[np.flatnonzero(np.append(True, row[order][1:] != row[order][:-1]))]
        r = row[first].astype(np.int64)
        top[r], grain[r], which[r] = -each[first, 2], each[first, 3], each[first, 4]
        return top, which, grain, each[-each[:, 2] >= least][:, [0, 4]].astype(np.int64)


def scan(docs: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """Append ``own_license``, ``similarity`` (of the deciding template), ``grain`` and ``all_licenses`` to every row."""
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(*document_frequencies(docs, text)))  # of the templates' and the sketch's size
    added = T.StructType.fromDDL("own_license string, similarity double, grain string, all_licenses array<string>")

    def look(column: pa.Array) -> list[pa.Array]:
        s = scanner.value
        found = [(w.first, *s.best(w, least)) for w in words(column, ALNUM)]
        value, which, grain = (np.concatenate([np.zeros(0), *(f[k] for f in found)]) for k in (1, 2, 3))
        names = [s.names[int(k)] if v >= least else None for v, k in zip(value, which, strict=True)]
        grains = [("line", "paragraph", "whole")[int(g)] if v > 0 else None for v, g in zip(value, grain, strict=True)]
        every: list[set] = [set() for _ in range(len(column))]
        for first, *_, pairs in found:
            for r, k in np.unique(pairs, axis=0).tolist():
                every[first + r].add(s.names[k])
        return [pa.array(names, pa.string()), pa.array(value, pa.float64()), pa.array(grains, pa.string()), pa.array([sorted(e) for e in every], pa.list_(pa.string()))]

    return append(docs, text, added, look)


def directory(path: Column) -> Column:
    """The directory of a path; empty at the top, null for null."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def inherit(files: DataFrame, is_license_file: Column, path: str = "path") -> DataFrame:
    """Append ``license`` and ``inherited_from`` to files with ``own_license``.

    ``is_license_file`` says which files speak for their directory; a file's own
    licence comes first, and ``inherited_from`` is null then.
    """
    kept = [c for c in files.columns if c.lower() not in ("license", "inherited_from")]
    # the row travels as one value, so that no name of its columns can clash with those here
    rows = files.select(F.struct(*map(col, kept)).alias("row"), col(path).alias("path"), col("own_license").alias("own"), F.coalesce(is_license_file, F.lit(False)).alias("speaks"))
    rows = rows.withColumn("dir", directory(F.col("path")))
    spoken = rows.where("speaks AND own IS NOT NULL AND path IS NOT NULL").groupBy("dir").agg(F.min(F.struct("path", "own")).alias("x")).select("dir", F.col("x.own").alias("license"))
    # ancestors of the distinct directories, not of the files
    parts = F.split("of", "/")
    depth = F.when(F.col("of") == "", 0).otherwise(F.size(parts))
    above = F.transform(F.sequence(F.lit(0), depth), lambda i: F.array_join(F.slice(parts, 1, F.size(parts) - i), "/"))
    above = F.when(F.col("of") == "", F.array(F.lit(""))).otherwise(above)
    dirs = rows.where("path IS NOT NULL").select(F.col("dir").alias("of")).distinct().select("of", F.posexplode(above).alias("up", "dir"))
    nearest = dirs.join(spoken, "dir").groupBy("of").agg(F.min(F.struct("up", "dir", "license")).alias("near"))
    out = rows.join(nearest, F.col("dir") == F.col("of"), "left")
    field = lambda c: F.col("row.`" + c.replace("`", "``") + "`").alias(c)
    return out.select(*map(field, kept), F.coalesce("own", "near.license").alias("license"), F.when(F.col("own").isNull(), F.col("near.dir")).alias("inherited_from"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all of ``documents``, own or inherited.

    The table has no paths, so document d of source s and language l counts as the
    file ``s/l/(d mod 64)/d.txt``; one with a licence line speaks for the directory
    it lies in, or for one or two above when d mod 3 is 1 or 2.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    found = materialise(scan(docs).drop("text"), "licences")  # read three times below, scanned once
    place = [F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.coalesce((F.col("doc_id") % 64).cast("string"), F.lit("none"))]
    up = F.when(F.col("own_license").isNull(), 0).otherwise(F.coalesce(F.col("doc_id"), F.lit(0)) % 3).cast("int")
    path = F.concat_ws("/", F.array_join(F.slice(F.array(*place), F.lit(1), 3 - up), "/"), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")))
    done = inherit(found.withColumn("path", path), F.col("own_license").isNotNull())
    return done.select("doc_id", "path", "own_license", F.round("similarity", 9).alias("similarity"), "grain", "license", "inherited_from", "all_licenses")

"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text (runs of letters and digits, A-Z lower-cased) and
the beginnings of its longer words, hashed into ``BUCKETS``; a text has each of
its terms once.  The machine's score is a bias, a weight per term, and for each
pair of terms the product of their factors; so an insult next to the mention of
a group can weigh more than both apart, which a linear model cannot say.

It is fitted over all hashed terms of a sample of at most ``SAMPLE`` labelled texts
and ``SAMPLE_TERMS`` terms (texts in order of a hash of their id, documented
bounds), by adaptive gradients with proximal steps: weights are penalised by their
size, the more the less a term alone says about the label, and a term's factors as
a group.  So a term without any say of its own still gets factors if pairs with it
tell the labels apart.  Every whole text is scored where it lies, in batches.

Defined results: a null or empty text, and one without known terms, gets the
bias alone; rows without a label, and labels of absent rows, are not learned
from; without labelled rows, or with one label only, every score is 0.0 or the
share of label 1.  Repeated rows are scored one by one; a very long text is scored
by itself, whole; an empty table gives an empty result.  Columns named like the
outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoaudit.llm._frames import append, col
from geoaudit.llm._words import ALNUM, Words, ragged, words
from geoaudit.session import dematerialise, materialise, table

BUCKETS = 1 << 18
#: Labelled texts that the machine is fitted on, and terms of them, at most.
SAMPLE = 20_000
SAMPLE_TERMS = 6_000_000
#: Bytes of the word beginnings that are terms as well.
BEGINNINGS = (4, 5, 6)
FACTORS = 8
#: Texts in a step; rounds over the sample at least, and more of them up to so many steps or terms met.
BATCH = 128
ROUNDS = 5
STEPS = 600
VISITS = 20_000_000
#: Penalties of weights (of terms whose z-score is PLAIN_Z or more) and of factors; rates of both.
WEIGHT_PENALTY, FACTOR_PENALTY = 1e-4, 8e-3
PLAIN_Z = 4.0
WEIGHT_RATE, FACTOR_RATE = 0.2, 0.1


def terms(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions of words, buckets) for whole words and for each kind of beginning."""
    low = np.uint64(64 - BUCKETS.bit_length() + 1)
    out = [(np.arange(len(w.starts)), (w.hashes >> low).astype(np.int64))]
    size = w.ends - w.starts
    for n in BEGINNINGS:
        at = np.flatnonzero(size > n)
        h = w.span_hash(w.starts[at], w.starts[at] + n) * np.uint64(2 * n + 1)
        out.append((at, (h >> low).astype(np.int64)))
    return out


def known_terms(w: Words, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of a chunk, each pair once; ``index`` numbers buckets, -1 where unknown."""
    rows = w.rows
    width = int(index.max(initial=0)) + 1
    found = []
    for at, bucket in terms(w):
        term = index[bucket]
        hit = term >= 0
        found.append(np.unique(rows[at[hit]] * width + term[hit]))
    pairs = np.unique(np.concatenate(found))
    return pairs // width, pairs % width


@dataclass
class Machine:
    """A fitted machine: bias, weights and factors by term, and the number of each bucket."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    index: np.ndarray

    def raw(self, n: int, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Scores before the logistic function of n texts with terms (rows, cols), in order of rows."""
        out = np.full(n, self.bias)
        if len(rows):
            first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            held = self.factors[cols]
            pairs = (np.add.reduceat(held, first, 0) ** 2).sum(1) - np.add.reduceat((held**2).sum(1), first)
            out[rows[first]] += np.add.reduceat(self.weights[cols], first) + pairs / 2
        return out


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def sample_terms(labelled: DataFrame) -> DataFrame:
    """``(place, y, size, buckets)`` of labelled texts: the buckets of each text's terms, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(BUCKETS)
        for b in batches:
            lists = []
            for w in words(b.column("text"), ALNUM):
                rows, cols = known_terms(w, every)
                lists += np.split(cols.astype(np.int32), np.searchsorted(rows, np.arange(1, w.last - w.first)))
            yield pa.RecordBatch.from_arrays([b.column("place"), b.column("y").cast(pa.int32()), pa.array([len(x) for x in lists], pa.int64()), pa.array(lists, pa.list_(pa.int32()))], names=["place", "y", "size", "buckets"])

    return labelled.select("place", "text", "y").mapInArrow(run, "place long, y int, size long, buckets array<int>")


def shrunk(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - by, 0)


def step(flat: np.ndarray, at: np.ndarray, size: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, ...]:
    """The texts ``some`` by text and by term.

    Returns the texts, their distinct terms, the number among these of each term of
    each text with each text's first place, and the texts' numbers by term with
    each term's first place.
    """
    n = size[some]
    cols = ragged(flat, at[some], n)
    row = np.repeat(np.arange(len(some), dtype=np.uint8), n)
    order = np.argsort(cols, kind="stable")
    by = cols[order]
    runs = np.flatnonzero(np.append(True, by[1:] != by[:-1]))
    term = np.empty(len(cols), np.int32)
    term[order] = np.repeat(np.arange(len(runs), dtype=np.int32), np.diff(np.append(runs, len(by))))
    return some, by[runs], term, np.cumsum(n) - n, row[order], runs


def fit(sample: pa.Table, seed: int = 7) -> Machine:
    """Fit on a bounded sample of ``(y, buckets)``."""
    y = sample.column("y").to_numpy().astype(np.float32)
    nothing = Machine(-40.0 if not len(y) or not y.any() else 40.0, np.zeros(1), np.zeros((1, FACTORS)), np.full(BUCKETS, -1, np.int32))
    if not len(y) or y.min() == y.max():
        return nothing
    # the sample stays in Arrow's own arrays; nothing as wide as a machine word is made for a term
    buckets = sample.column("buckets").combine_chunks()
    size = pc.list_value_length(buckets).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, label = buckets.flatten().to_numpy(), np.repeat(y > 0, size)
    total, ones = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for s in range(0, len(flat), 1 << 18):
        part = flat[s : s + (1 << 18)]
        total += np.bincount(part, minlength=BUCKETS)
        ones += np.bincount(part[label[s : s + (1 << 18)]], minlength=BUCKETS)
    seen = np.flatnonzero(total)
    m, share = max(1, len(seen)), float(y.mean())
    number = np.zeros(BUCKETS, np.int32)
    number[seen] = np.arange(len(seen))
    flat = number[flat]
    total, ones = (x[seen] if len(seen) else np.zeros(1, np.int64) for x in (total, ones))
    z = np.abs(ones - total * share) / np.sqrt(np.maximum(total * share * (1 - share), 1e-9))
    del sample, buckets, label
    # a term that says little by itself gets a weight only against a high penalty
    penalty = (WEIGHT_PENALTY * np.maximum(1, (PLAIN_Z / np.maximum(z, 1e-3)) ** 4)).astype(np.float32)
    # texts of many terms take smaller steps: they move the score by all of them
    scale = 1 / np.sqrt(max(1.0, size.mean()))
    draw = np.random.Generator(np.random.Philox(seed))
    w, v, bias = np.zeros(m, np.float32), draw.normal(0, 0.2 * scale, (m, FACTORS)).astype(np.float32), float(np.log(share / (1 - share)))
    gw, gv, gb = np.full(m, 1e-4, np.float32), np.full(m, 1e-4, np.float32), 1e-8
    order = draw.permutation(np.flatnonzero(size > 0))
    at = np.cumsum(size) - size
    steps = [step(flat, at, size, order[s : s + BATCH]) for s in range(0, len(order), BATCH)]
    for _ in range(max(ROUNDS, min(-(-STEPS // max(1, len(steps))), VISITS // max(1, len(flat))))):
        for k in draw.permutation(len(steps)).tolist():
            some, used, term, first, row, runs = steps[k]
            wu, vu = w[used], v[used]
            sums = np.add.reduceat(vu[term], first, 0)
            pairs = (sums**2).sum(1) - np.add.reduceat((vu**2).sum(1)[term], first)
            slope = ((logistic(bias + np.add.reduceat(wu[term], first) + pairs / 2) - y[some]) / len(some)).astype(np.float32)
            # by term: the slopes of its texts, and those times the texts' sums of factors
            back = np.add.reduceat(np.concatenate([slope[:, None], slope[:, None] * sums], 1)[row], runs, 0)
            dw, dv = back[:, 0], back[:, 1:] - vu * back[:, :1]
            gw[used] += dw**2
            gv[used] += (dv**2).sum(1)
            rate = WEIGHT_RATE / np.sqrt(gw[used])
            w[used] = shrunk(wu - rate * dw, rate * penalty[used])
            rate = FACTOR_RATE * scale / np.sqrt(gv[used])
            moved = vu - rate[:, None] * dv
            length = np.sqrt((moved**2).sum(1))
            v[used] = moved * np.maximum(0, 1 - rate * FACTOR_PENALTY / np.maximum(length, 1e-12))[:, None]
            db = float(slope.sum())
            gb += db**2
            bias -= 0.05 * db / np.sqrt(gb)
    live = np.flatnonzero((w != 0) | (v != 0).any(1))
    index = np.full(BUCKETS, -1, np.int32)
    index[seen[live]] = np.arange(len(live))
    return Machine(bias, np.append(w[live], 0).astype(np.float64), np.concatenate([v[live], np.zeros((1, FACTORS))]), index)


def learn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, most_terms: int = SAMPLE_TERMS) -> Machine:
    """Fit on the ``sample`` labelled texts with the least hash of their id, as far as their terms are ``most_terms`` at most."""
    few = labels.select(col(id).alias("k"), (col(label) == 1).cast("int").alias("y")).where("k IS NOT NULL AND y IS NOT NULL")
    few = few.withColumn("place", F.xxhash64("k")).orderBy("place", "k", "y").limit(sample)
    # bounded by the parameter: ids and labels of the sample
    labelled = docs.select(col(id).alias("i"), col(text).alias("text")).join(F.broadcast(few), F.col("i") == F.col("k"))
    made = materialise(sample_terms(labelled), "terms")
    # the places and sizes of at most ``sample`` texts (repeated ids aside) tell how far the terms reach
    sizes = made.groupBy("place").agg(F.sum("size").alias("n")).orderBy("place").toArrow()
    reach = np.cumsum(sizes.column("n").to_numpy()) if sizes.num_rows else np.zeros(0)
    last = sizes.column("place")[int(max(0, np.searchsorted(reach, most_terms, "right") - 1))].as_py() if sizes.num_rows else 0
    machine = fitted(made.where(F.col("place") <= last))
    dematerialise(made)
    return machine


def fitted(terms: DataFrame) -> Machine:
    """:func:`fit` of a bounded sample, in a task of its own: the driver gets the machine, never the terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            m = fit(pa.Table.from_batches(held))
            columns = [pa.array([m.bias]), pa.array([m.weights], pa.list_(pa.float64())), pa.array([m.factors.ravel()], pa.list_(pa.float64())), pa.array([m.index], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["bias", "weights", "factors", "index"])

    sample = terms.repartition(1).sortWithinPartitions("place", "y", "size").select("y", "buckets")
    one = sample.mapInArrow(run, "bias double, weights array<double>, factors array<double>, index array<int>").toArrow()
    if not one.num_rows:
        return fit(pa.table({"y": pa.array([], pa.int32()), "buckets": pa.array([], pa.list_(pa.int32()))}))
    bias, (weights, factors, index) = one.column("bias")[0].as_py(), (one.column(c).combine_chunks().flatten().to_numpy() for c in ("weights", "factors", "index"))
    return Machine(bias, weights, factors.reshape(-1, FACTORS), index)


def score(df: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """Append ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) to every row."""
    shared = df.sparkSession.sparkContext.broadcast(machine)  # BUCKETS numbers and as many factors at most
    added = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def rate(column: pa.Array) -> list[pa.Array]:
        m = shared.value
        raw = [m.raw(w.last - w.first, *known_terms(w, m.index)) for w in words(column, ALNUM)]
        p = logistic(np.concatenate([np.zeros(0), *raw]))
        return [pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))]

    return append(df, text, added, rate)


def held_out(id: str = "doc_id") -> Column:
    """Whether a row is never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(col(id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all of ``documents``; learn from the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = learn(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, machine).select("doc_id", held_out().alias("held_out"), "score", "predicted")

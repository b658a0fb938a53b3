"""Language identification by multilingual mixture inference.

Each language has a distribution over hashed n-grams (three bytes of the text
with A-Z lower-cased and everything but letters a blank).  A text is a mixture:
every word was drawn from one of its languages.  The set of languages starts with
the likeliest one and grows by the language along which the likelihood rises most
steeply; expectation-maximisation over the words' likelihoods estimates the
proportions of each set.  It grows as long as the penalised likelihood (half the
logarithm of the number of words per further language) improves, with no bound on
its size; where the slope itself bounds the gain below the penalty, the larger set
is not tried.  The prediction is the largest share of the chosen set, the score
that share.

The distributions are counted over all labelled texts, where they lie; only one
fixed-size array per language comes together.

Defined results: a text that is null or has no letter is ``und`` with score 0,
as is every text if nothing was learned; rows with a null language teach
nothing; repeated rows are predicted one by one; a very long text is handled by
itself, whole; an empty table gives an empty result.  Columns named like the
outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoaudit.llm._frames import append, col
from geoaudit.llm._words import chunks, flat
from geoaudit.session import table

GRAMS = 1 << 15
SMOOTHING = 0.5
#: Rounds of expectation-maximisation.
ROUNDS = 8

#: Bytes of letters: A-Z as a-z, and all bytes of non-ASCII characters; others are blanks.
LETTERS = np.full(256, 32, np.uint32)
LETTERS[65:91] = np.arange(97, 123)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


def grams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where letters stand, and the hashed n-gram around each; texts do not see each other."""
    x = LETTERS[data]
    before, after = np.full(len(x), 32, np.uint32), np.full(len(x), 32, np.uint32)
    before[1:], after[:-1] = x[:-1], x[1:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(x))]
    before[inner], after[inner - 1] = 32, 32
    at = np.flatnonzero(x != 32)
    value = before[at] << 16 | x[at] << 8 | after[at]
    return at, (value * np.uint32(2654435761) >> np.uint32(17)).astype(np.int64)


@dataclass
class Languages:
    """Names, and by n-gram the logarithm of its probability in each language."""

    names: list[str]
    logs: np.ndarray  # GRAMS x languages


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Languages:
    """Count the n-grams of every labelled text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            names, codes = np.unique(np.asarray(b.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True) if b.num_rows else ([], None)
            data, offsets = flat(b.column("text"))
            total = np.zeros(len(names) * GRAMS, np.int64)
            for i, j in chunks(offsets):
                bounds = offsets[i : j + 1] - offsets[i]
                at, gram = grams(data[offsets[i] : offsets[j]], bounds)
                row = np.searchsorted(bounds, at, "right") - 1
                total += np.bincount(codes[i + row] * GRAMS + gram, minlength=len(total))
            for k, name in enumerate(names):
                held[str(name)] = held.get(str(name), 0) + total[k * GRAMS : (k + 1) * GRAMS]
        yield from _arrays(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held[name] = held.get(name, 0) + np.frombuffer(raw.as_buffer(), np.int64)
        yield from _arrays(held)

    shape = "lang string, counts binary"
    known = docs.select(col(lang).cast("string").alias("lang"), col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    parts = known.mapInArrow(count, shape).repartition("lang").mapInArrow(add, shape)
    found = {r["lang"]: np.frombuffer(r["counts"], np.int64) for r in parts.toLocalIterator()}  # one row per language
    names = sorted(found)
    if not names:
        return Languages([], np.zeros((GRAMS, 0), np.float32))
    counts = np.stack([found[n] for n in names], 1) + SMOOTHING
    return Languages(names, np.log(counts / counts.sum(0)).astype(np.float32))


def _arrays(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for name, counts in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([counts.tobytes()], pa.binary())], names=["lang", "counts"])


def mixtures(likelihood: np.ndarray, cuts: np.ndarray, words: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each text and its log-likelihood, up to what does not depend on them.

    ``likelihood``: words x languages; ``cuts``: first word of each text;
    ``words``: how many it has; ``allowed``: texts x languages, which may take part.
    """
    share = allowed / allowed.sum(1, keepdims=True)
    for k in range(rounds + 1):
        joint = likelihood * np.repeat(share, words, 0)
        total = joint.sum(1)
        np.maximum(total, 1e-30, out=total)
        if k == rounds:
            return share, np.add.reduceat(np.log(total), cuts)
        joint /= total[:, None]
        share = np.add.reduceat(joint, cuts, 0) / words[:, None]
    raise AssertionError


def infer(model: Languages, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows with letters, shares by language in the chosen set, prediction) of a chunk."""
    at, gram = grams(data, bounds)
    row = np.searchsorted(bounds, at, "right") - 1
    if not len(at):
        return np.zeros(0, np.int64), np.zeros((0, len(model.names))), np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])))
    ll = np.add.reduceat(model.logs[gram], first, 0)
    ll -= ll.max(1, keepdims=True)
    likelihood = np.exp(np.maximum(ll, -60)).astype(np.float64)
    texts, cuts, words = np.unique(row[first], return_index=True, return_counts=True)
    n, k = len(texts), len(model.names)
    alone = np.add.reduceat(np.log(np.maximum(likelihood, 1e-30)), cuts, 0)
    best, chosen = alone.max(1), np.zeros((n, k))
    chosen[np.arange(n), alone.argmax(1)] = 1.0
    live = np.arange(n)
    for size in range(2, k + 1):
        mine = np.zeros(n, bool)
        mine[live] = True
        some, own_words = likelihood[np.repeat(mine, words)], words[live]
        starts = np.cumsum(own_words) - own_words
        total = np.maximum((some * np.repeat(chosen[live], own_words, 0)).sum(1), 1e-30)
        slope = np.add.reduceat(some / total[:, None], starts, 0) / own_words[:, None]
        slope[chosen[live] > 0] = 0.0
        penalty = np.log(own_words + 1.0) / 2
        # no mixture of further languages gains more than this
        hope = own_words * np.log(np.maximum(slope.max(1), 1e-30)) > penalty
        if not hope.any():
            break
        words_of = np.repeat(hope, own_words)
        live, own_words, some = live[hope], own_words[hope], some[words_of]
        allowed = (chosen[live] > 0).astype(float)
        allowed[np.arange(len(live)), slope[hope].argmax(1)] = 1.0
        own, value = mixtures(some, np.cumsum(own_words) - own_words, own_words, allowed)
        value -= (size - 1) * penalty[hope]
        better = value > best[live]
        live = live[better]
        best[live], chosen[live] = value[better], own[better]
        if not len(live):
            break
    return texts, chosen, chosen.argmax(1)


def predict(df: DataFrame, model: Languages, text: str = "text") -> DataFrame:
    """Append ``lang_pred``, ``score`` and ``lang_set`` (the chosen languages, largest share first)."""
    added = T.StructType.fromDDL("lang_pred string, score double, lang_set array<string>")
    shared = df.sparkSession.sparkContext.broadcast(model)  # GRAMS numbers for each language

    def name(column: pa.Array) -> list[pa.Array]:
        m, n = shared.value, len(column)
        data, offsets = flat(column)
        which, score, sizes, sets = np.full(n, len(m.names)), np.zeros(n), np.zeros(n, np.int64), [np.zeros(0, np.int64)]
        for i, j in chunks(offsets) if m.names else ():
            part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            rows, share, best = infer(m, part, bounds)
            plain = np.append(0, np.cumsum((LETTERS[part] != 32) & (part < 128)))[bounds]
            spelt = plain[rows + 1] > plain[rows]
            for r in np.flatnonzero(~spelt).tolist():  # texts without A to Z: is any character a letter?
                spelt[r] = any(c.isalpha() for c in part[bounds[rows[r]] : bounds[rows[r] + 1]].tobytes().decode("utf-8", "replace"))
            rows, share, best = rows[spelt], share[spelt], best[spelt]
            which[i + rows], score[i + rows] = best, np.minimum(1.0, share[np.arange(len(rows)), best])
            order = np.argsort(-share, 1, kind="stable")
            held = np.take_along_axis(share, order, 1) > 0
            sizes[i + rows] = held.sum(1)
            sets.append(order[held])
        names = pa.array([*m.names, "und"], pa.string())
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), names.take(pa.array(np.concatenate(sets))))
        return [names.take(pa.array(which)), pa.array(score), lists]

    return append(df, text, added, name)


def held_out(id: str = "doc_id") -> Column:
    """Whether a row is never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(col(id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of all of ``documents``; learn from those not held out."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "lang_set")

"""Benchmark decontamination by spaced-seed hashing.

A spaced seed is a fixed mask over some consecutive words that ignores certain
positions; words are runs of letters and digits, A-Z lower-cased, and single
characters of scripts without spaces.  All masks of ``MASKS`` are applied at every
word of every benchmark item and of every whole document, and the hashes joined.
A window of ``WINDOW`` words of which at most a fifth were substituted keeps at
least one mask's positions intact, wherever the substitutions are (the tests try
all ways), so no such overlap is lost.  An item of fewer than ``SHORTEST`` words
has the masks of its whole length that ignore a fifth of it, in all ways.

Documents are hashed in one pass; a bitmap of fixed size, made of the
benchmark's hashes, lets only hashes through that could join.  Hits that lie
close together form a region, which keeps its distinct hashes, its words and a
margin around them.  A region and an item that share a hash are brought together
once, whatever they share; the diagonals of their common seeds are then found and
verified word by word.

A seed that many items and many regions share (an opening phrase) says little, and
all its pairs would be too many.  Such heavy seeds bring nobody together.  Instead
the windows around them get the full masks, which ignore a fifth of the window in all
ways: two windows share one of those exactly if they overlap.  A window that overlaps
has a seed that is not heavy, or one that is; so nothing is lost, and what is brought
together by full masks is an overlap.

An overlap is reported when, along one diagonal, a window of ``WINDOW`` words (the
whole item if that is shorter) agrees in 80 % of its words or more.

Defined results: null or empty texts and items have no overlaps; rows with a null
id are not reported; repeated rows give the same overlap once; ties between equal
overlaps go to the first place in the document; a very long text is hashed by
itself, whole; empty tables give an empty result.  Other columns are unused.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoaudit.llm._words import ALNUM, mix, words
from geoaudit.session import materialise, table

#: The spaced seeds; 1 counts, 0 is ignored.
MASKS = ["111111", "1110111", "11011011", "11101011", "110100111", "110011101"]
#: Words of a window, and the share of them that must agree, in percent.
WINDOW = 13
PERCENT = 80
#: Items with fewer words have masks of their own length.
SHORTEST = 8
#: Pairs of an item and a region that one seed may bring together.
HEAVY = 4096
#: Words kept on either side of a region of hits.
MARGIN = 64
#: Bits of the bitmap that benchmark hashes are looked up in first.
FILTER_BITS = 1 << 24

_STEP = np.uint64(0xA24BAED4963EE407 | 1)


def seeds(h: np.ndarray, masks: list[str] = MASKS) -> Iterator[tuple[int, np.ndarray]]:
    """For each mask its span and its hash at every word (regardless of where texts end)."""
    for mask in masks:
        n = len(h) - len(mask) + 1
        if n <= 0:
            yield len(mask), np.zeros(0, np.uint64)
            continue
        acc = np.full(n, int("1" + mask, 2), np.uint64)
        for at, used in enumerate(mask):
            if used == "1":
                acc *= _STEP
                acc += h[at : at + n]
        yield len(mask), mix(acc)


def ignored(size: int) -> list[tuple[int, ...]]:
    """All ways to ignore as many of ``size`` words as an overlap may have substituted."""
    return list(itertools.combinations(range(size), size - -(-PERCENT * size // 100)))


def masks_for(words_of_item: int) -> list[str]:
    """The masks of an item: the spaced ones, or for a short item its whole length less a fifth of it."""
    if words_of_item >= SHORTEST:
        return MASKS
    return ["".join("0" if k in some else "1" for k in range(words_of_item)) for some in ignored(words_of_item)]


def full_keys(h: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """A hash for every window of ``size`` words and way to ignore some of them: equal where all others are."""
    ways = ignored(size)
    x = mix(h[starts[:, None] + np.arange(size)] + np.arange(1, size + 1).astype(np.uint64) * _STEP)
    key = np.repeat(x.sum(1)[:, None], len(ways), 1)
    for at in np.array(ways).reshape(len(ways), -1).T:
        key -= x[:, at]
    return np.unique(mix(key + (np.arange(len(ways)) + 256 * size).astype(np.uint64) * _STEP))


def windows_with(h: np.ndarray, heavy: np.ndarray, size: int) -> np.ndarray:
    """Where windows of ``size`` words begin that hold one of the heavy seeds."""
    most = len(h) - size
    edge = np.zeros(max(0, most) + 2, np.int32)
    if most < 0:
        return np.zeros(0, np.int64)
    for span, x in seeds(h, MASKS):
        if span <= size:
            at = np.flatnonzero(np.isin(x, heavy))
            np.add.at(edge, np.clip(at + span - size, 0, most + 1), 1)
            np.add.at(edge, np.minimum(at, most) + 1, -1)
    return np.flatnonzero(np.cumsum(edge)[:-1] > 0)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def item_hashes(items: DataFrame) -> DataFrame:
    """``(item_id, n, hash, tokens)``: distinct seeds of each item, and its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("item_id").to_pylist()
            out: dict[str, list] = {"item_id": [], "n": [], "hash": [], "tokens": []}
            for w in words(b.column("text"), ALNUM, apart=True):
                h = w.hashes
                for row in range(w.last - w.first):
                    own = h[w.at[row] : w.at[row + 1]]
                    if not len(own):
                        continue
                    out["item_id"].append(ids[w.first + row])
                    out["n"].append(len(own))
                    out["hash"].append(np.unique(np.concatenate([x for _, x in seeds(own, masks_for(len(own)))])).view(np.int64))
                    out["tokens"].append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in (("item_id", pa.int64()), ("n", pa.int64()), ("hash", pa.list_(pa.int64())), ("tokens", pa.binary()))], names=list(out))

    return items.where("item_id IS NOT NULL").mapInArrow(run, "item_id long, n long, hash array<long>, tokens binary")


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Bitmap of fixed size of a column ``hash``; each task makes one, the driver joins them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(FILTER_BITS, bool)
        for b in batches:
            held[_slot(b.column(0).to_numpy().view(np.uint64))] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(held).tobytes()], pa.binary())], names=["bits"])

    total = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in hashes.coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        total |= np.frombuffer(r["bits"], np.uint8)
    return total


REGION = "region long, doc_id long, first int, tokens binary, hash array<long>"
_REGION = {"region": pa.int64(), "doc_id": pa.int64(), "first": pa.int32(), "tokens": pa.binary(), "hash": pa.list_(pa.int64())}


def regions(docs: DataFrame, bits: np.ndarray, masks: list[str]) -> DataFrame:
    """Regions of documents whose seeds pass the bitmap, with their words and distinct seeds."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # FILTER_BITS / 8 bytes whatever the benchmark

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = np.unpackbits(shared.value).view(bool)
        number = TaskContext.get().partitionId() << 40
        for b in batches:
            ids = b.column("doc_id")
            out: dict[str, list] = {c: [] for c in _REGION}
            for w in words(b.column("text"), ALNUM, apart=True):
                h = w.hashes
                ends = w.at[1:]
                places, hashes = [], []
                for span, x in seeds(h, masks):
                    at = np.flatnonzero(held[_slot(x)])
                    at = at[at + span <= ends[np.searchsorted(ends, at, "right")]] if len(at) else at
                    places.append(at)
                    hashes.append(x[at])
                place, seed = np.concatenate(places), np.concatenate(hashes)
                if not len(place):
                    continue
                order = np.argsort(place, kind="stable")
                place, seed = place[order], seed[order]
                row = np.searchsorted(ends, place, "right")
                cut = np.flatnonzero((row[1:] != row[:-1]) | (place[1:] - place[:-1] > MARGIN)) + 1
                for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(place)], strict=True):
                    r = int(row[i])
                    lo, hi = max(int(w.at[r]), int(place[i]) - MARGIN), min(int(w.at[r + 1]), int(place[j - 1]) + MARGIN)
                    number += 1
                    out["region"].append(number)
                    out["doc_id"].append(ids[w.first + r].as_py())
                    out["first"].append(lo - int(w.at[r]))
                    out["tokens"].append(h[lo:hi].tobytes())
                    out["hash"].append(np.unique(seed[i:j]).view(np.int64))
            if out["region"]:
                yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in _REGION.items()], names=list(_REGION))

    return docs.where("doc_id IS NOT NULL").mapInArrow(run, REGION)


def diagonals(doc: np.ndarray, first: int, item: np.ndarray) -> np.ndarray:
    """Diagonals on which document words, numbered from ``first``, and an item share a seed.

    On diagonal d item word i meets document word d + i.
    """
    masks = masks_for(len(item))
    on = np.zeros(len(doc) + len(item), bool)
    for (_, x), (_, y) in zip(seeds(doc, masks), seeds(item, masks), strict=True):
        order = np.argsort(x, kind="stable")
        lo, hi = np.searchsorted(x[order], y, "left"), np.searchsorted(x[order], y, "right")
        for p in np.flatnonzero(hi > lo).tolist():
            on[order[lo[p] : hi[p]] - p + len(item)] = True
    return np.flatnonzero(on) + first - len(item)


def best_overlap(doc: np.ndarray, first: int, item: np.ndarray) -> tuple[int, int, int] | None:
    """``(agreeing, start, end)`` in document words: of all diagonals the overlap that agrees in most words, then the first."""
    m, best = len(item), None
    size = min(WINDOW, m)
    lines = diagonals(doc, first, item)
    for some in np.array_split(lines, max(1, len(lines) * m >> 20)):
        at = some[:, None] - first + np.arange(m)
        inner = (at >= 0) & (at < len(doc))
        same = inner & (doc[np.clip(at, 0, len(doc) - 1)] == item)
        sums = np.zeros((len(some), m + 1), np.int32)
        np.cumsum(same, 1, out=sums[:, 1:])
        good = (100 * (sums[:, size:] - sums[:, :-size]) >= PERCENT * size) & inner[:, : m - size + 1] & inner[:, size - 1 :]
        edges = np.zeros((len(some), m + 1), np.int32)
        edges[:, : m - size + 1] += good
        edges[:, size:] -= good
        agree = same & (np.cumsum(edges, 1)[:, :-1] > 0)
        count = agree.sum(1)
        top = np.flatnonzero((count == count.max(initial=1)) & (count > 0))
        if len(top):
            start = some + agree.argmax(1)
            k = top[start[top].argmin()]
            got = int(count[k]), int(start[k]), int(some[k] + m - agree[k, ::-1].argmax())
            best = got if best is None else max(best, got, key=lambda g: (g[0], -g[1]))
    return best


def _full(rows: DataFrame, name: str, sizes: list[int]) -> DataFrame:
    """``(name, key)``: the full keys of the windows of ``tokens`` around the seeds in ``heavy``; an item shorter than a window is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one, tokens, heavy in zip(b.column(name).to_pylist(), b.column("tokens").to_pylist(), b.column("heavy"), strict=True):
                h, seeds_ = np.frombuffer(tokens, np.uint64), heavy.values.to_numpy().view(np.uint64)
                own = [s for s in sizes if s <= len(h)] if name == "region" else [min(WINDOW, len(h))]
                keys = np.unique(np.concatenate([full_keys(h, windows_with(h, seeds_, s), s) for s in own])) if own else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), one)), pa.array(keys.view(np.int64))], names=[name, "key"])

    return rows.select(name, "tokens", "heavy").mapInArrow(run, f"{name} long, key long")


def candidates(known: DataFrame, found: DataFrame) -> DataFrame:
    """``(region, item_id)`` of all that may overlap, each pair once."""
    asked = known.select("item_id", "n", F.explode("hash").alias("hash"))
    at = found.select("region", F.explode("hash").alias("hash"))
    long = asked.where(F.col("n") >= SHORTEST)
    count = lambda df, c: df.groupBy("hash").agg(F.count(F.lit(1)).alias(c))
    heavy = materialise(count(long, "i").join(count(at, "r"), "hash").where(F.col("i") * F.col("r") > HEAVY).select("hash"), "heavy")
    light = long.join(heavy, "hash", "left_anti").select("item_id", "hash").union(asked.where(F.col("n") < SHORTEST).select("item_id", "hash"))
    met = at.join(light, "hash").select("region", "item_id")
    if not heavy.isEmpty():
        having = lambda df, c: df.join(heavy, "hash").groupBy(c).agg(F.collect_list("hash").alias("heavy"))
        sizes = [r[0] for r in known.where(F.col("n") >= SHORTEST).select(F.least("n", F.lit(WINDOW))).distinct().collect()]  # six at most
        items = _full(known.join(having(long, "item_id"), "item_id"), "item_id", sizes)
        around = _full(found.drop("hash").join(having(at, "region"), "region"), "region", sizes)
        met = met.union(around.join(items, "key").select("region", "item_id"))
    return met.distinct()


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, agreeing, item_words, start_word, end_word)``: the best overlap of each pair.

    ``docs`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``.
    """
    known = materialise(item_hashes(items.select("item_id", "text")), "items")
    short = [r[0] for r in known.where(F.col("n") < SHORTEST).select("n").distinct().collect()]  # a few small numbers
    exploded = known.select("item_id", F.explode("hash").alias("hash"))
    masks = MASKS + [m for n in sorted(short) for m in masks_for(n) if m not in MASKS]
    found = materialise(regions(docs.select("doc_id", "text"), bitmap(exploded.select("hash")), masks), "regions")
    tried = candidates(known, found).join(found.select("region", "doc_id", "first", F.col("tokens").alias("doc")), "region").join(known.select("item_id", F.col("tokens").alias("item")), "item_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, i, first, doc, item in zip(*(b.column(c).to_pylist() for c in ("doc_id", "item_id", "first", "doc", "item")), strict=True):
                item = np.frombuffer(item, np.uint64)
                if got := best_overlap(np.frombuffer(doc, np.uint64), first, item):
                    out.append((d, i, got[0], len(item), got[1], got[2]))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "agreeing", "item_words", "start_word", "end_word"])

    shape = "doc_id long, item_id long, agreeing long, item_words long, start_word long, end_word long"
    each = tried.select("doc_id", "item_id", "first", "doc", "item").mapInArrow(run, shape)
    best = each.groupBy("doc_id", "item_id", "item_words").agg(F.max(F.struct("agreeing", (-F.col("start_word")).alias("s"), "end_word")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.agreeing").alias("agreeing"), "item_words", (-F.col("b.s")).alias("start_word"), F.col("b.end_word").alias("end_word"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All overlaps of ``documents`` with ``benchmark``; documents without one do not appear."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

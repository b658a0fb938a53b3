"""Repeated byte strings by longest-previous-factor arrays over suffixes in order.

A byte goes if a string of ``length`` bytes that covers it also starts elsewhere (in
another document or in the same one).  Suffixes are brought together by content: of
every window of ``length`` bytes the least-hashed gram of ``GRAM`` bytes is its anchor
(of equal hashes the first), so equal windows have equal anchors and meet in one
bucket, however far apart they lie.  The windows that share an occurrence of an anchor
form one segment.  What is shuffled at this level is one small row per segment.

Equal segments are one, with a count: they need no further look.  Different segments
of one anchor are fetched and their suffixes sorted by doubling ranks, where suffixes
without a partner drop out.  In suffix order the previous and the next smaller place
of a suffix, within the neighbours that agree on ``length`` bytes, are its earlier
matches (the array of longest previous factors, as far as it reaches ``length``);
greater places likewise are later ones.  A bucket of more than ``CROWD`` different
segments (a passage in very many surroundings) is not brought together: Spark counts
equal blocks of its windows by 128-bit digests instead, and the 128-bit hashes of single
windows where blocks differ around bytes that they share, with the same result.

``keep="none"`` removes every copy, ``keep="first"`` leaves the earliest one, in the
order of ``doc_id`` (nulls last) and place.

Texts are told apart by their MD5, segments by anchor and 64-bit keyed digest.
Defined results: a null text is empty; rows may share a ``doc_id`` or have none (they
are copies of each other if their texts are equal; with ``keep="first"`` rows equal in
both stay together); texts shorter than ``length`` lose nothing; an empty table gives
an empty result; further columns pass through, those named like the added ones are
replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoaudit.llm._frames import col
from geoaudit.llm._words import U, eights, flat, mix
from geoaudit.session import materialise, table

LENGTH = 400
#: Bytes of a gram; at least 8, and no more than ``length``.
GRAM = 32
#: Windows of a text that are handled at once.
PIECE = 1 << 21
#: Different segments of an anchor that one task compares, and bytes that it sorts at once.
CROWD = 1024
CELL = 1 << 21
#: Windows of a crowded segment that are judged together, at first and where that does not tell.
BLOCKS = (64, 8)
#: Segments that leave a task together.
SOME = 1 << 15
_PLACE = U((1 << 24) - 1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place on (as far as they are there)."""
    x, n = eights(data), len(data) - gram + 1
    h = np.full(n, 0x9E3779B97F4A7C15, U)
    for k in [*range(0, gram - 7, 8), *([gram - 8] if gram % 8 else [])]:
        h = mix(h ^ x[k : k + n])
    return h


def lowest(v: np.ndarray, w: int) -> np.ndarray:
    """The least of every ``w`` values in a row."""
    n = len(v)
    padded = np.full(-(-n // w) * w, np.iinfo(U).max, U)
    padded[:n] = v
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def segments(data: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(anchor hash, first window, windows)`` of the segments of a text, a piece at a time."""
    for lo in range(0, len(data) - length + 1, PIECE):
        part = data[lo : lo + PIECE + length - 1]
        h = gram_hashes(part, gram)
        at = (lowest((h & ~_PLACE) | np.arange(len(h), dtype=U), length - gram + 1) & _PLACE).astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        yield h[at[start]].view(np.int64), start + lo, np.diff(np.append(start, len(at)))


_SEGMENT = pa.list_(pa.struct([("h", pa.int64()), ("d", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("c", pa.int64())]))
_SPAN = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))


def _anchored(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Per row: text key, id, its distinct segments with their counts, and the windows of segments seen before in the same text."""

    def lists(kind: pa.ListType, sizes: list[int], rows: list[tuple]) -> pa.Array:
        columns = np.array(rows, np.int64).reshape(len(rows), kind.value_type.num_fields).T
        items = pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(kind.value_type))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes, dtype=np.int32)), pa.int32()), items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = flat(b.column("text"))
            texts, own, owned, again, agains = [], [], [], [], []

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([b.column("key").take(texts), b.column("doc").take(texts), lists(_SEGMENT, owned, own), lists(_SPAN, agains, again)], names=["key", "doc", "own", "again"])  # noqa: B023

            for i in np.flatnonzero(np.diff(offsets) >= length).tolist():
                text = data[offsets[i] : offsets[i + 1]]
                view, found, spans = memoryview(text), {}, []
                for hs, starts, ns in segments(text, length, gram):
                    for h, at, n in zip(hs.tolist(), starts.tolist(), ns.tolist(), strict=True):
                        d = int.from_bytes(hashlib.blake2b(view[at : at + n + length - 1], digest_size=8).digest(), "little", signed=True)
                        s = found.get((h, d))
                        if s is None:
                            found[h, d] = [at, n, 1]
                            continue
                        s[2] += 1
                        if spans and spans[-1][0] + spans[-1][1] == at:
                            spans[-1][1] += n
                        else:
                            spans.append([at, n])
                texts.append(i)
                own += [(h, d, *s) for (h, d), s in found.items()]
                owned.append(len(found))
                again += spans
                agains.append(len(spans))
                if len(own) > SOME:
                    yield made()
                    texts, own, owned, again, agains = [], [], [], [], []
            if texts:
                yield made()

    return docs.mapInArrow(run, f"key binary, doc {docs.schema['doc'].dataType.simpleString()}, own array<struct<h:long,d:long,at:long,n:long,c:long>>, again array<struct<at:long,n:long>>")


def nearest(values: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """For each value the place of the last smaller one before it within its run, or -1; ``fresh`` marks where runs begin.

    Everything between a place and the one it points to is known to be no smaller, so
    pointers can follow pointers, and all places do so at once.
    """
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(values)), 0))
    to = np.arange(len(values)) - 1
    to[fresh] = -1
    open_ = np.flatnonzero(to >= 0)
    while len(open_):
        open_ = open_[values[to[open_]] >= values[open_]]
        to[open_] = to[to[open_]]
        open_ = open_[to[open_] >= first[open_]]
    to[to < first] = -1
    return to


def alike(data: np.ndarray, wanted: np.ndarray, length: int) -> np.ndarray:
    """The wanted places whose ``length`` bytes hash like those of another wanted one: all that can agree with one, and hardly more."""
    h = window_hashes(data, length, 0)[wanted]
    order = np.argsort(h)
    h = h[order]
    same = h[1:] == h[:-1]
    shared = np.zeros(len(wanted), bool)
    shared[order] = np.append(same, False) | np.append(False, same)
    return wanted[shared]


def suffix_order(data: np.ndarray, wanted: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The wanted suffixes that agree with another one on ``length`` bytes, in order, and where the runs of such begin.

    Every wanted suffix has ``length`` bytes at least.  Ranks of 8, 16, ... bytes
    follow from ranks of half as many; a suffix alone with its rank drops out.  Only
    what lies in the bytes of suffixes that hash alike is ranked.
    """

    def ranked(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(key)  # equal keys may come in any order
        at, key = at[order], key[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        shared = ~(fresh & np.append(fresh[1:], True))
        return at[shared], fresh[shared], np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))[shared]

    wanted = alike(data, wanted, length) if len(wanted) else wanted
    asked = np.bincount(wanted, minlength=len(data) + 1) - np.bincount(wanted + (length - 7), minlength=len(data) + 1)
    at = np.flatnonzero(np.cumsum(asked))
    rank = np.full(len(data) + 1, -1, np.int64)
    at, fresh, r = ranked(at, eights(data)[at].byteswap())
    rank[at] = r
    reach = 8
    while reach < length:
        step = min(reach, length - reach)
        if reach + step == length:
            at = wanted[(rank[wanted] >= 0) & (rank[wanted + step] >= 0)]
        else:
            at = np.flatnonzero((rank[:-step] >= 0) & (rank[step:] >= 0))
        at, fresh, r = ranked(at, rank[at] * len(rank) + rank[at + step])
        rank = np.full(len(rank), -1, np.int64)
        rank[at] = r
        reach += step
    return at, fresh


def matches(data: np.ndarray, wanted: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each wanted suffix has an earlier and a later match of ``length`` bytes; ``place`` orders the suffixes."""
    order, fresh = suffix_order(data, wanted, length)
    back = np.full(len(data) + 1, -1)
    back[wanted] = np.arange(len(wanted))
    at = back[order]
    p = place[at]
    # runs seen from behind
    ends = np.append(fresh[1:], True)[::-1] if len(fresh) else fresh
    either = lambda v: (nearest(v, fresh) >= 0) | (nearest(v[::-1], ends) >= 0)[::-1]
    earlier, later = np.zeros(len(wanted), bool), np.zeros(len(wanted), bool)
    earlier[at], later[at] = either(p), either(-p)
    return earlier, later


def _runs(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return [{"at": a, "n": b - a} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


_OUT = pa.schema([("h", pa.int64()), ("d", pa.int64()), ("runs", _SPAN)])


def _compared(t: pa.Table, length: int, first: bool) -> pa.Table:
    """The runs of windows of every segment of a cell that have a match (an earlier one only, with ``first``)."""
    out: dict[tuple[int, int], list[dict]] = {}
    t = t.sort_by([("h", "ascending"), ("d", "ascending")]).combine_chunks()
    hs, ds = t.column("h").to_numpy(), t.column("d").to_numpy()
    alone = np.ones(len(hs), bool)  # a row that came with several copies of a text counts once
    alone[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    t = t.filter(pa.array(alone)).combine_chunks()
    hs, ds, ns = (t.column(c).to_numpy() for c in ("h", "d", "n"))
    # segments of one text are together in the order of places, texts in that of their ids
    docs = [(x is None, x if x is not None else 0, k) for x, k in zip(t.column("doc").to_pylist(), t.column("key").to_pylist(), strict=True)]
    rank = {x: i for i, x in enumerate(sorted(set(docs)))}
    base = np.array([rank[x] for x in docs], np.int64) * (1 << 40) + t.column("at").to_numpy() if len(docs) else np.zeros(0, np.int64)
    text = t.column("text")
    size = ns + length - 1
    bounds = np.flatnonzero(np.concatenate(([True], hs[1:] != hs[:-1]))).tolist() + [len(hs)] if len(hs) else []
    lo = 0
    while lo < len(hs):
        hi = next(b for b in bounds if b > lo)
        for b in bounds:
            if b > hi and size[lo:b].sum() <= CELL:
                hi = b
        data = np.frombuffer(b"".join(x.as_py() for x in text.slice(lo, hi - lo)), np.uint8)
        start = np.cumsum(size[lo:hi]) - size[lo:hi]
        n = ns[lo:hi]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        earlier, later = matches(data, np.repeat(start, n) + inside, np.repeat(base[lo:hi], n) + inside, length)
        flags = earlier if first else earlier | later
        for i, part in enumerate(np.split(flags, np.cumsum(n)[:-1])):
            if part.any():
                out[hs[lo + i], ds[lo + i]] = _runs(part)
        lo = hi
    return pa.table([pa.array([k[0] for k in out], pa.int64()), pa.array([k[1] for k in out], pa.int64()), pa.array(list(out.values()), _SPAN)], schema=_OUT)


def window_hashes(data: np.ndarray, length: int, seed: int) -> np.ndarray:
    """A hash of the ``length`` bytes from each place on, by doubling."""
    h = mix(eights(data)[: max(0, len(data) - 7)] + U(seed))
    reach = 8
    while reach < length:
        step = min(reach, length - reach)
        h = mix(h[:-step] * U(0xD6E8FEB86659FD93) + mix(h[step:] + U(reach)))
        reach += step
    return h


def _cut(texts: DataFrame, length: int, crowded: bool) -> DataFrame:
    """The bytes of every asked segment, of crowded ones or of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = flat(b.column("text"))
            for i, asked in enumerate(b.column("asked")):
                text = data[offsets[i] : offsets[i + 1]]
                rows = [r for r in asked.as_py() if r["crowd"] == crowded]
                many = lambda c, n: pa.array([b.column(c)[i].as_py()] * n, b.column(c).type)  # noqa: B023, E731
                for lo in range(0, len(rows), 512):
                    part = rows[lo : lo + 512]
                    h, d, at, n = (np.array([r[c] for r in part], np.int64) for c in ("h", "d", "at", "n"))
                    bytes_ = [text[a : a + k + length - 1].tobytes() for a, k in zip(at.tolist(), n.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(d), many("key", len(part)), many("doc", len(part)), pa.array(at), pa.array(n), pa.array(bytes_, pa.binary())], names=["h", "d", "key", "doc", "at", "n", "text"])

    return texts.mapInArrow(run, f"h long, d long, key binary, doc {texts.schema['doc'].dataType.simpleString()}, at long, n long, text binary")


def _pieces(parts: DataFrame, length: int, gram: int, width: int) -> DataFrame:
    """Parts of crowded segments cut into blocks of ``width`` places before the anchor.

    Places are counted from the farthest one that a window with the anchor can have, so
    equal windows have equal places.  A block has ``core``, a digest of the bytes that
    any window of its places covers, and ``all``, one of its windows' places and bytes.
    ``place`` of whole segments is not known yet (-1).
    """
    doc = parts.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda x, i, n: hashlib.blake2b(x, digest_size=16, salt=i.to_bytes(8, "little"), person=n.to_bytes(8, "little")).digest()
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                rows, out = [], []
                for r, (j, place, n, text) in enumerate(zip(*(part.column(c).to_pylist() for c in ("j", "place", "n", "text")), strict=True)):
                    if place < 0:
                        grams = gram_hashes(np.frombuffer(text, np.uint8)[:length], gram) & ~_PLACE
                        place = length - gram - int(grams.argmin())
                    for first in range(place - place % width, place + n, width):
                        a, z = max(first, place), min(first + width, place + n)
                        bytes_, k = text[a - place : z - place + length - 1], first + width - 1 - a
                        rows.append(r)
                        out.append((j + a - place, a, z - a, bytes_, digest(bytes_[k : max(k, first + length - a)], first, 0), digest(bytes_, a, z - a)))
                columns = [pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 6, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(rows, pa.int64())) for c in ("h", "d", "key", "doc", "at")), *columns], names=["h", "d", "key", "doc", "at", "j", "place", "n", "text", "core", "all"])

    return parts.mapInArrow(run, f"h long, d long, key binary, doc {doc}, at long, j long, place long, n long, text binary, core binary, all binary")


def _windows(parts: DataFrame, length: int) -> DataFrame:
    """Two hashes of every window of the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                n = part.column("n").to_numpy()
                i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(part.column("j").to_numpy(), n)
                texts = [np.frombuffer(x.as_py(), np.uint8) for x in part.column("text")]
                hashes = [np.concatenate([window_hashes(x, length, seed) for x in texts] or [np.zeros(0, U)]).view(np.int64) for seed in (1, 2)]
                many = lambda c: part.column(c).take(pa.array(np.repeat(np.arange(len(n)), n)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([many("h"), many("d"), pa.array(i), *(pa.array(x) for x in hashes), many("key"), many("doc"), pa.array(np.repeat(part.column("at").to_numpy(), n) + i)], names=["h", "d", "j", "x", "y", "key", "doc", "at"])

    return parts.mapInArrow(run, f"h long, d long, j long, x long, y long, key binary, doc {parts.schema['doc'].dataType.simpleString()}, at long")


def _crowded(segments_: DataFrame, length: int, gram: int, first: bool) -> DataFrame:
    """The runs of crowded segments, by counting equal blocks of windows; only of blocks that share no more than their core the windows themselves are counted.

    Equal blocks are judged as one: all have a match (all but the earliest, with
    ``first``), and the earliest stands for them where other blocks share its core.
    """
    parts = segments_.dropDuplicates(["h", "d"]).withColumns({"j": F.lit(0).cast("long"), "place": F.lit(-1).cast("long")})
    order = F.struct(F.col("doc").isNull().alias("n"), "doc", "key", (F.col("at") + F.col("j")).alias("at"))
    runs = None
    for width in BLOCKS:
        pieces = materialise(_pieces(parts, length, gram, width), "pieces")
        equal = materialise(pieces.groupBy("h", "all").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(order.alias("order"), "d", "key", "doc", "at", "j", "place", "n", "text", "core")).alias("e")), "equal")
        hit = pieces.drop("text", "core").join(equal.where("c > 1").select("h", "all", F.col("e.d").alias("lead")), ["h", "all"])
        if first:
            hit = hit.where("d <> lead")
        found = hit.select("h", "d", F.struct(F.col("j").alias("at"), "n").alias("run"))
        runs = found if runs is None else runs.union(found)
        several = equal.groupBy("h", F.col("e.core").alias("core")).agg(F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
        parts = equal.select("h", "e.*").drop("order").join(several, ["h", "core"]).drop("core")
    whole = runs.groupBy("h", "d").agg(F.collect_list("run").alias("runs"))
    both = whole.union(_crowds(_windows(parts, length), first))
    return both.groupBy("h", "d").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def _crowds(hashes: DataFrame, first: bool) -> DataFrame:
    """Runs of windows that have a match (an earlier one only, with ``first``), by counting their hashes."""
    place = F.struct(F.col("doc").isNull().alias("n"), "doc", "key", "at")
    rows = hashes.dropDuplicates(["h", "d", "j", "x", "y"])
    seen = rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("least")).where("c > 1")
    hit = rows.join(seen, ["x", "y"])
    if first:
        hit = hit.where(place != F.col("least"))
    places = hit.groupBy("h", "d").agg(F.array_sort(F.collect_set("j")).alias("j"))
    # runs of consecutive places: one begins where the place before is missing, and ends where the next one is; a segment has fewer windows than a window has bytes
    edges = lambda step: F.array_except(F.col("j"), F.transform("j", lambda p: p + step))
    runs = F.zip_with(edges(1), edges(-1), lambda a, z: F.struct(a.alias("at"), (z - a + 1).alias("n")))
    return places.select("h", "d", runs.alias("runs"))


def _merged(spans: DataFrame) -> DataFrame:
    """``(key, spans)`` with sorted maximal spans, from a list of overlapping ones per key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for found in b.column("spans"):
                flat_ = found.values
                at, to = flat_.field("at").to_numpy(), flat_.field("to").to_numpy()
                order = np.argsort(at, kind="stable")
                at, to = at[order], np.maximum.accumulate(to[order])
                new = np.concatenate(([True], at[1:] > to[:-1]))
                last = np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)
                out.append([{"at": a, "to": z} for a, z in zip(at[new].tolist(), to[last].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, pa.list_(pa.struct([("at", pa.int64()), ("to", pa.int64())])))], names=["key", "spans"])

    return spans.mapInArrow(run, "key binary, spans array<struct<at:long,to:long>>")


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def repeated(docs: DataFrame, length: int = LENGTH, keep: str = "none", gram: int = GRAM) -> DataFrame:
    """The rows of ``docs`` (``doc_id``, ``text`` and others) with ``spans``: sorted maximal runs of bytes to remove, as ``(at, to)``."""
    if keep not in ("none", "first"):
        raise ValueError(f"keep is 'none' or 'first', not {keep!r}")
    if not 8 <= gram <= length:
        raise ValueError("a gram has at least 8 bytes and fits into the length")
    first = keep == "first"
    whole = F.coalesce(col("text"), F.lit(""))
    plain = docs.select(_key(whole).alias("key"), col("doc_id").alias("doc"), whole.alias("text"))
    rows = _anchored(plain, length, gram)
    texts = materialise(rows.groupBy("key").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies"), F.first("own").alias("own"), F.first("again").alias("again")), "texts")
    places = texts.select("key", "doc", "copies", F.explode("own").alias("s")).select("key", "doc", "s.h", "s.d", "s.at", "s.n", (F.col("s.c") * F.col("copies")).alias("c"), (F.col("copies") > 1).alias("copied"))
    shared = places.groupBy("h").agg(F.sum("c").alias("m"), (F.min("d") != F.max("d")).alias("multi")).where("m > 1").select("h", "multi")
    related = materialise(places.join(shared, "h"), "related")
    place = F.struct(F.col("doc").isNull().alias("n"), "doc", "key", "at")
    found = materialise(related.groupBy("h", "d").agg(F.sum("c").alias("c"), F.min(place).alias("rep"), F.max("n").alias("n"), F.max("multi").alias("multi")), "segments")

    # different segments of one anchor: fetch them from the texts that hold their first occurrences
    several = found.where("multi")
    crowd = several.groupBy("h").agg((F.count(F.lit(1)) > CROWD).alias("crowd"))
    asked = several.join(crowd, "h").groupBy(F.col("rep.key").alias("key"), F.col("rep.doc").alias("first")).agg(F.collect_list(F.struct("h", "d", F.col("rep.at").alias("at"), "n", "crowd")).alias("asked"))
    holders = plain.join(asked, "key").where(F.col("doc").eqNullSafe(F.col("first"))).drop("first")
    bytes_, crowded = several.join(crowd, "h").agg(F.sum(F.when(~F.col("crowd"), F.col("n") + length - 1)), F.sum(F.when(F.col("crowd"), F.lit(1)))).first()
    verdicts = found.sparkSession.createDataFrame([], "h long, d long, runs array<struct<at:long,n:long>>")
    if bytes_:
        cells = max(1, -(-bytes_ // CELL))
        cut = _cut(holders, length, False).withColumn("cell", F.pmod(F.xxhash64("h"), F.lit(cells)))
        verdicts = verdicts.union(cut.groupBy("cell").applyInArrow(lambda t: _compared(t, length, first), verdicts.schema))
    if crowded:
        verdicts = verdicts.union(_crowded(_cut(holders, length, True), length, gram, first))

    judged = found.select("h", "d", "rep", F.col("c").alias("of")).join(verdicts, ["h", "d"], "left").where("of > 1 OR runs IS NOT NULL")
    members = related.where("NOT copied") if not first else related
    at = members.join(judged, ["h", "d"])
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("at"), F.col("n").alias("n")))
    if first:
        leads = (F.col("key") == F.col("rep.key")) & (F.col("at") == F.col("rep.at"))
        runs = F.when(leads, F.col("runs")).otherwise(all_of_it)
    else:
        runs = F.when(F.col("of") > 1, all_of_it).otherwise(F.col("runs"))
    span = lambda c: F.struct(c.alias("at"), (c + F.col("r.n") + F.lit(length - 1)).alias("to"))
    windows = at.select("key", "at", F.explode(runs).alias("r")).select("key", span(F.col("at") + F.col("r.at")).alias("s"))
    again = texts.select("key", F.explode("again").alias("r")).select("key", span(F.col("r.at")).alias("s"))
    spans = _merged(windows.union(again).groupBy("key").agg(F.collect_list("s").alias("spans")))

    copied = texts.where("copies > 1").select("key", "doc", F.lit(True).alias("copied"))
    outcome = spans.join(copied, "key", "full").withColumnsRenamed({"key": "__key", "doc": "__first", "copied": "__copied", "spans": "__spans"})
    named = docs.withColumn("__text_key", _key(whole))
    joined = named.join(outcome, F.col("__text_key") == F.col("__key"), "left")
    entire = F.array(F.struct(F.lit(0).cast("long").alias("at"), F.octet_length(whole).cast("long").alias("to")))
    copy = F.coalesce(F.col("__copied"), F.lit(False))
    if first:
        copy = copy & ~col("doc_id").eqNullSafe(F.col("__first"))
    none = F.array().cast("array<struct<at:long,to:long>>")
    kept = [c for c in docs.columns if c.lower() != "spans"]
    return joined.select(*(col(c) for c in kept), F.when(copy, entire).otherwise(F.coalesce("__spans", none)).alias("spans"))


def remaining(text: bytes, spans: list[dict]) -> list[bytes]:
    """What is left of a text, piece by piece."""
    out, at = [], 0
    for s in spans:
        out.append(text[at : s["at"]])
        at = s["to"]
    return [*out, text[at:]]


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what repeated strings of 400 bytes leave of it."""
    found = repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    shape = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans in zip(b.column("text"), b.column("spans"), strict=True):
                whole, gone, digest = (text.as_py() or "").encode(), spans.as_py(), hashlib.sha256()
                for piece in remaining(whole, gone):
                    digest.update(piece)
                rows.append((len(whole), sum(s["to"] - s["at"] for s in gone), len(gone), digest.hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.mapInArrow(run, shape)

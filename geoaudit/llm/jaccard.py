"""Similarity join of texts on distinct word shingles, with signature trees.

A text's set holds the hashes of its distinct five-word shingles.  Two texts
link when ``100 * |intersection| >= 80 * |union|`` (the parameters say which).
Sets are taken under two independent 64-bit hashes of the words: equal sets need
equal fingerprints under both, and a link must hold under both, so that one hash
that two words share makes no link.

1. One pass over the texts makes, per text, the set's size, a fingerprint under
   each hash, a few minimum hashes and a signature (a bitmap with one bit set per
   shingle), and a fixed-size sketch of how often shingles occur.  Equal sets
   become one class.
2. Texts that share a minimum hash meet in blocks of bounded size, together with
   the block's leader.  A signature tree over the block is traversed against
   itself; what its bounds leave is verified on the whole sets, and pairs that
   are connected already are passed over.  This settles dense groups cheaply; it
   need not be complete.
3. To be complete, every class sends its prefix: in an order that puts frequent
   shingles last (by the sketch first; if a shingle is still in more than ``HEAVY``
   open prefixes, the shingles of the texts concerned are counted exactly, and once
   more with all those of more than ``HEAVY`` texts last; any order is right), its first ``n - ceil(0.8 n) + k`` shingles, of which linked sets
   share at least the lesser k (k is one and a twentieth of the set's size).  Shingles whose classes all lie in one component so
   far say nothing new and drop out.  The classes of each other shingle, if they
   are more than a few, are put into trees (in blocks of like sizes when they are
   many; pairs of blocks whose sizes rule out a link are never made) and traversed
   two at a time; the pairs of few are counted over
   all shingles and need k.  What remains is tested with wider bitmaps and then
   verified on the whole sets.
4. All links found, and each class's members, go through connected components.

A signature tree's nodes hold the OR of the bitmaps below them, their range of
sizes, and the most bits that one set lost to collisions.  The overlap of any
two sets below two nodes is at most the bits both have in common plus that loss,
and at most the larger size; node pairs that cannot reach the threshold are cut.

Defined results: a null or empty text and one without words has an empty set and
links with nothing; a text with fewer words than a shingle has one shingle, its
whole sequence.  A null id gives a null component.  Rows with the same id stand
for one node; every input row comes back.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoaudit.llm._words import mix, sets_of, shingle_sets, words
from geoaudit.operators.components import components
from geoaudit.session import dematerialise, materialise, table

#: Bits of the bitmaps in trees; of a long text's own bitmap at most.
BITS = 2048
MOST_BITS = 1 << 16
KEYS = 2
BLOCK = 256
#: Groups up to this size are paired directly: a tree of them would be its leaves.
SMALL = 8
FAN = 8
#: Open prefixes that a shingle may be in before shingles are counted exactly; how many are then put last at most.
HEAVY = 4 * BLOCK
LISTED = 1 << 21
#: Links from which on one task finishes the components: rounds of jobs over so few cost the driver more than they save.
FEW = 1 << 16
#: Counters of the sketch of shingle frequencies, and how many travel together.
SKETCH = 1 << 24
SKETCH_PART = 1 << 18
#: Seed of the second hash of words.
SECOND = 1
_SEEDS = mix(np.arange(1, KEYS + 1).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
_U = np.uint64


class Tree:
    """A signature tree over some sets: ``levels[0]`` are the sets, each next level joins FAN nodes.

    ``order`` gives the position of each leaf in the arrays handed in: sets of
    like size stand together.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.order = np.argsort(sizes, kind="stable")
        sizes, bits = sizes[self.order], bits[self.order]
        loss = sizes - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [(bits, sizes, sizes, loss)]
        while len(bits) > 1:
            cuts = np.arange(0, len(bits), FAN)
            _, low, high, loss = self.levels[-1]
            bits = np.bitwise_or.reduceat(bits, cuts)
            self.levels.append((bits, np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(loss, cuts)))

    def level(self, k: int) -> tuple[np.ndarray, ...]:
        return self.levels[min(k, len(self.levels) - 1)]


def possible(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether two sets below nodes a[i] and b[j] could reach the threshold."""
    low_a, high_a, low_b, high_b = a[1][i], a[2][i], b[1][j], b[2][j]
    ok = (100 * high_a >= percent * low_b) & (100 * high_b >= percent * low_a)
    common = np.zeros(len(i), np.int64)
    at = np.flatnonzero(ok)
    for k in range(0, len(at), 4096):
        s = at[k : k + 4096]
        common[s] = np.bitwise_count(a[0][i[s]] & b[0][j[s]]).sum(1, dtype=np.int64)
    most = np.minimum(common + np.minimum(a[3][i], b[3][j]), np.minimum(high_a, high_b))
    # overlap >= t * (|x| + |y| - overlap), with the least sizes below the nodes
    return ok & ((100 + percent) * most >= percent * (low_a + low_b))


def traverse(a: Tree, b: Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves (as positions in the arrays the trees were made of) that may link.

    Of a tree against itself each pair comes once.  At most some thousand node
    pairs are open at a time per level.
    """
    top = max(len(a.levels), len(b.levels)) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        k, i, j = stack.pop()
        left, right = a.level(k), b.level(k)
        keep = possible(left, right, i, j, percent)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if k == 0:
            if a is b:
                i, j = i[i < j], j[i < j]
            yield a.order[i], b.order[j]
            continue
        more_i, more_j = _children(i, len(a.levels) - 1 < k), _children(j, len(b.levels) - 1 < k)
        i, j = np.repeat(more_i, more_j.shape[1], 1).ravel(), np.tile(more_j, (1, more_i.shape[1])).ravel()
        inside = (i < len(a.level(k - 1)[1])) & (j < len(b.level(k - 1)[1]))
        if a is b:
            inside &= i <= j
        i, j = i[inside], j[inside]
        for s in range(0, len(i), 1 << 15):
            stack.append((k - 1, i[s : s + (1 << 15)], j[s : s + (1 << 15)]))


def _children(i: np.ndarray, same: bool) -> np.ndarray:
    """Children of each node; a tree that is lower than the other waits at its root."""
    return i[:, None] if same else i[:, None] * FAN + np.arange(FAN)


def links(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    common = int(np.count_nonzero(y[at] == x))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _bitmap(s: np.ndarray, most: int = BITS) -> bytes:
    """One bit per shingle: in BITS bits, or in up to ``most`` for a set that would fill them."""
    width = min(max(BITS, 1 << (4 * len(s) - 1).bit_length()), most)
    held = np.zeros(width, bool)
    held[(s & _U(width - 1)).astype(np.int64)] = True
    return np.packbits(held).tobytes()


def _fold(bits: bytes, size: int) -> np.ndarray:
    """A bitmap at a smaller width, in bytes: the OR of its equal pieces."""
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint8).reshape(-1, size), 0)


def bitmaps(column: pa.Array) -> np.ndarray:
    """A column of bitmaps of BITS as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), BITS // 64)


FEATURES = "id long, n long, fp_a long, fp_b long, keys array<long>, bits binary, wide binary, part int, counts binary"
_ARROW = {"id": pa.int64(), "n": pa.int64(), "fp_a": pa.int64(), "fp_b": pa.int64(), "keys": pa.list_(pa.int64()), "bits": pa.binary(), "wide": pa.binary(), "part": pa.int32(), "counts": pa.binary()}


def _long(x: np.ndarray | int) -> int:
    return int(np.asarray(x).astype(np.uint64).view(np.int64).reshape(()))


def fingerprint(s: np.ndarray) -> int:
    """An order-free digest of a set."""
    return _long(np.bitwise_xor.reduce(mix(s), keepdims=True) + s.sum(dtype=np.uint64, keepdims=True))


def both_sets(texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its set under either hash of the words."""
    for w in words(texts):
        yield from zip(sets_of(w, w.hashes, k), sets_of(w, w.span_hash(w.starts, w.ends, SECOND), k), strict=True)


def features(df: DataFrame, k: int) -> DataFrame:
    """One row per text, and at the end of each task its part of the sketch (with ``part`` set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, np.uint32)
        for b in batches:
            ids = b.column("id")
            out: dict[str, list] = {c: [] for c in ("n", "fp_a", "fp_b", "keys", "bits", "wide")}
            pending, waiting = [], 0
            for s, t in both_sets(b.column("text"), k):
                out["n"].append(len(s))
                if not len(s):
                    for c in ("fp_a", "fp_b", "keys", "bits", "wide"):
                        out[c].append(None)
                    continue
                out["fp_a"].append(fingerprint(s))
                out["fp_b"].append(fingerprint(t))
                out["keys"].append([_long(mix(s ^ seed).min()) for seed in _SEEDS])
                out["bits"].append(_bitmap(s))
                out["wide"].append(_bitmap(s, MOST_BITS) if 4 * len(s) > BITS else None)
                pending.append(s)
                waiting += len(s)
                if waiting > 1 << 20:
                    _count(sketch, pending)
                    waiting = 0
            _count(sketch, pending)
            made = [ids, *(pa.array(out[c], _ARROW[c]) for c in out), pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=list(_ARROW))
        for p in range(SKETCH // SKETCH_PART):
            counts = np.minimum(sketch[p * SKETCH_PART : (p + 1) * SKETCH_PART], 255).astype(np.uint8)  # only an order hangs on it
            if counts.any():
                row = {"part": [p], "counts": [zlib.compress(counts.tobytes(), 1)]}
                yield pa.RecordBatch.from_arrays([pa.array(row.get(c, [None]), t) for c, t in _ARROW.items()], names=list(_ARROW))

    return df.mapInArrow(run, FEATURES)


def _slot(s: np.ndarray) -> np.ndarray:
    return (s >> _U(40)).astype(np.int64)


def _count(sketch: np.ndarray, pending: list[np.ndarray]) -> None:
    if pending:
        np.add.at(sketch, _slot(np.concatenate(pending)), 1)
        pending.clear()


def frequency_classes(known: DataFrame) -> np.ndarray:
    """How frequent each slot of the sketch is, in powers of two above the mean; SKETCH bytes.

    Parts of the sketch are summed where they lie after one shuffle of pieces of
    bounded size; the driver gets one array of fixed size.
    """
    shingles = known.where("part IS NULL").agg(F.sum("n")).first()[0] or 0
    mean = max(shingles / SKETCH, 1.0)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held[p] = held.get(p, 0) + np.frombuffer(zlib.decompress(raw.as_buffer()), np.uint8).astype(np.int64)
        for p, total in held.items():
            kind = np.log2(np.maximum(total / mean, 1)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([kind.tobytes()], pa.binary())], names=["part", "kinds"])

    kinds = np.zeros(SKETCH, np.uint8)
    summed = known.where("part IS NOT NULL").select("part", "counts").repartition("part").mapInArrow(add, "part int, kinds binary")
    for r in summed.toLocalIterator():
        kinds[r["part"] * SKETCH_PART : (r["part"] + 1) * SKETCH_PART] = np.frombuffer(r["kinds"], np.uint8)
    return kinds


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of sorted batches by runs of equal keys; runs are bounded by how they were made."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [np.asarray(b.column(k).to_numpy(zero_copy_only=False)) for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        change[0] = last is not None and first != last
        cuts = np.flatnonzero(change).tolist()
        at = 0
        for c in cuts:
            held.append(b.slice(at, c - at))
            yield pa.Table.from_batches([h for h in held if h.num_rows])
            held, at = [], c
        held.append(b.slice(at))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def _pairs_batch(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_in_blocks(members: DataFrame, k: int, percent: int) -> DataFrame:
    """Verified links inside the blocks of step 2; ``members``: block, id, text, in runs of block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _runs(batches, ["key", "block"]):
            ids = g.column("id").to_numpy()
            ids, at = np.unique(ids, return_index=True)
            if len(ids) < 2:
                continue
            texts = g.column("text").take(pa.array(at)).combine_chunks()
            sets = list(shingle_sets(texts, k))
            sizes = np.array([len(s) for s in sets])
            tree = Tree(sizes, np.frombuffer(b"".join(map(_bitmap, sets)), np.uint64).reshape(len(sets), -1))
            root = np.arange(len(ids))
            a, b = [], []
            for i, j in traverse(tree, tree, percent):
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    if root[x] != root[y] and links(sets[x], sets[y], percent) and links(*shingle_sets(texts.take(pa.array([x, y])), k, SECOND), percent):
                        a.append(int(ids[x]))
                        b.append(int(ids[y]))
                        root[root == root[y]] = root[x]
            if a:
                yield _pairs_batch(a, b)

    return members.mapInArrow(run, "a long, b long")


def shared_least(n: int | np.ndarray) -> int | np.ndarray:
    """How many shingles of their prefixes linked sets share at least, by the lesser size."""
    return 1 + n // 20


def heavy_shingles(texts: DataFrame, k: int) -> np.ndarray:
    """Sorted shingles that more than HEAVY of the texts have, LISTED of the most frequent ones at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                sets = list(shingle_sets(b.column("text").slice(i, 512), k))
                token, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

    counted = texts.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > HEAVY)
    most = counted.orderBy(F.desc("n"), "token").limit(LISTED).select("token").toArrow()
    return np.sort(most.column("token").to_numpy().view(np.uint64)) if most.num_rows else np.zeros(0, np.uint64)


def prefixes(df: DataFrame, k: int, percent: int, classes: np.ndarray, last: np.ndarray) -> DataFrame:
    """``(token, fp)``: the prefix of each set, once per task for sets that are equal; shingles in ``last`` come last."""
    context = df.sparkSession.sparkContext
    shared, listed = context.broadcast(classes), context.broadcast(last)  # SKETCH bytes, and LISTED numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        kinds, last = shared.value, listed.value
        for b in batches:
            tokens, owners, sizes = [], [], []
            for s in shingle_sets(b.column("text"), k):
                n = len(s)
                if not n:
                    continue
                fp = fingerprint(s)
                if fp in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(fp)
                p = n - -(-percent * n // 100) + shared_least(n)
                kind = kinds[_slot(s)].astype(np.uint64)
                if len(last):
                    kind[last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s] = 63
                order = kind << _U(58) | mix(s) >> _U(6)
                tokens.append(s[np.argpartition(order, p - 1)[:p]] if p < n else s)
                owners.append(fp)
                sizes.append(len(tokens[-1]))
            if tokens:
                owner = np.repeat(np.array(owners, np.int64), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(owner)], names=["token", "fp"])

    return df.mapInArrow(run, "token long, fp long")


def shared_tokens(rows: DataFrame) -> DataFrame:
    """Of ``(token, fp)`` rows those whose token has several fps, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.zeros((0, 2), np.int64)  # the last token's only fp so far
        open_token = None  # the last token, if it has been found shared
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1)
            x = np.concatenate([tail, x])
            fresh = np.concatenate([[True], (x[1:] != x[:-1]).any(1)])
            x = x[fresh]
            same = np.concatenate([[False], x[1:, 0] == x[:-1, 0]])
            keep = same.copy()
            keep[:-1] |= same[1:]
            if open_token is not None:
                keep |= x[:, 0] == open_token
            tail = x[-1:]
            open_token = x[-1, 0] if keep[-1] else None
            keep[-1] = False
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep, 0]), pa.array(x[keep, 1])], names=["token", "fp"])
        if len(tail) and open_token is not None:
            yield pa.RecordBatch.from_arrays([pa.array(tail[:, 0]), pa.array(tail[:, 1])], names=["token", "fp"])

    return rows.repartition("token").sortWithinPartitions("token", "fp").mapInArrow(run, "token long, fp long")


def candidates(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that two trees' traversal leaves; ``members`` in runs of (token, i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _runs(batches, ["token", "i", "j"]):
            g = g.combine_chunks()
            ids, comp = g.column("id").to_numpy(), g.column("comp").to_numpy()
            block, sizes = np.asarray(g.column("block").to_pylist()), g.column("n").to_numpy()
            bits = bitmaps(g.column("bits"))
            i, j = g.column("i")[0].as_py(), g.column("j")[0].as_py()
            left = np.flatnonzero(block == i)
            right = np.flatnonzero(block == j)
            if not len(left) or not len(right):
                continue
            a = Tree(sizes[left], bits[left])
            b = a if i == j else Tree(sizes[right], bits[right])
            for x, y in traverse(a, b, percent):
                x, y = left[x], right[y]
                apart = comp[x] != comp[y]
                x, y = ids[x[apart]], ids[y[apart]]
                if len(x):
                    yield _pairs_batch(np.minimum(x, y), np.maximum(x, y))

    return members.mapInArrow(run, "a long, b long")


def small_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share enough shingles within groups of up to SMALL rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 4), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = np.concatenate([held, np.stack([b.column(c).to_numpy() for c in ("token", "id", "n", "comp")], 1)])
            cut = int(np.flatnonzero(np.append(True, x[1:, 0] != x[:-1, 0]))[-1])
            held, x = x[cut:], x[:cut]
            yield pairs(x)
        yield pairs(held)

    def pairs(x: np.ndarray) -> pa.RecordBatch:
        found = [np.zeros((0, 3), np.int64)]
        for d in range(1, min(SMALL, len(x))):
            y, z = x[:-d], x[d:]
            ok = (y[:, 0] == z[:, 0]) & (y[:, 3] != z[:, 3]) & (100 * y[:, 2] >= percent * z[:, 2]) & (100 * z[:, 2] >= percent * y[:, 2])
            y, z = y[ok], z[ok]
            found.append(np.stack([np.minimum(y[:, 1], z[:, 1]), np.maximum(y[:, 1], z[:, 1]), shared_least(np.minimum(y[:, 2], z[:, 2]))], 1))
        once, times = np.unique(np.concatenate(found), axis=0, return_counts=True)
        return pa.RecordBatch.from_arrays([*(pa.array(once[:, k]) for k in range(3)), pa.array(times, pa.int64())], names=["a", "b", "need", "times"])

    each = members.select("token", "id", "n", "comp").repartition("token").sortWithinPartitions("token").mapInArrow(run, "a long, b long, need long, times long")
    return each.groupBy("a", "b").agg(F.sum("times").alias("times"), F.min("need").alias("need")).where("times >= need").select("a", "b")


def promising(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Of pairs those whose own bitmaps leave the threshold within reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for n, m, x, y in zip(*(b.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b")), strict=True):
                size = min(len(x), len(y))
                u, v = _fold(x, size), _fold(y, size)
                both = int(np.bitwise_count(u & v).sum())
                loss = min(n - int(np.bitwise_count(u).sum()), m - int(np.bitwise_count(v).sum()))
                keep.append((100 + percent) * min(both + loss, n, m) >= percent * (n + m))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = reps.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.coalesce("wide", "bits").alias("bits_a"))
    two = reps.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.coalesce("wide", "bits").alias("bits_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of candidate pairs those whose whole sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                g = b.slice(s, 256)
                for seed in (0, SECOND):
                    ok = [links(x, y, percent) for x, y in zip(shingle_sets(g.column("text_a"), k, seed), shingle_sets(g.column("text_b"), k, seed), strict=True)]
                    g = g.filter(pa.array(ok, pa.bool_()))
                if g.num_rows:
                    yield g.select(["a", "b"])

    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def join_near(df: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``df`` its ``id``, ``n_shingles`` and ``component_id``.

    ``component_id`` is the least id that links lead to, the row's own included.
    """
    docs = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    known = materialise(features(docs, k), "features")
    rows = known.where("part IS NULL")
    filled = rows.where("n > 0 AND id IS NOT NULL")
    classes = frequency_classes(known)
    # equal sets: one class, known by its least id
    reps = filled.groupBy("fp_a", "fp_b", "n").agg(F.min("id").alias("rep"), F.first("keys").alias("keys"), F.first("bits").alias("bits"), F.first("wide").alias("wide"))
    reps = materialise(reps, "classes")
    same = filled.join(reps.select("fp_a", "fp_b", "n", "rep"), ["fp_a", "fp_b", "n"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))

    # step 2: blocks of texts that share a minimum hash
    keyed = reps.select("rep", F.explode("keys").alias("key"))
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("leader")).where("m > 1")
    met = keyed.join(groups, "key")
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    own = met.select("rep", "key", F.pmod(F.xxhash64("rep", "key"), parts).cast("int").alias("block"))
    led = met.where("rep = leader").select("rep", "key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("block"))
    seats = own.union(led).distinct()
    seated = seats.join(docs, F.col("rep") == F.col("id")).select("key", "block", "id", "text")
    blocks = seated.repartition("key", "block").sortWithinPartitions("key", "block")
    near = materialise(near_in_blocks(blocks, k, percent), "near")
    comps = materialise(components(near, few=FEW), "components")

    # step 3: prefixes whose classes are not all connected yet
    owners = reps.select(F.col("fp_a").alias("fp"), F.col("rep").alias("id"), "n")
    owners = owners.join(comps, F.col("id") == F.col("node"), "left").select("fp", "id", "n", F.coalesce("component", "id").alias("comp"))
    by_prefix = lambda last: materialise(shared_tokens(prefixes(docs.select("text"), k, percent, classes, last)).join(owners, "fp").select("token", "id", "n", "comp"), "tokens")
    open_of = lambda t: t.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi").select("token", "m")
    tokens = by_prefix(np.zeros(0, np.uint64))
    heavy = open_of(tokens).where(F.col("m") > HEAVY)
    if heavy.limit(1).count():
        crowd = tokens.join(heavy, "token").select("id").distinct()
        last = heavy_shingles(docs.join(crowd, "id", "left_semi"), k)
        dematerialise(tokens)
        tokens = by_prefix(last)
    open_tokens = open_of(tokens)
    mixed = tokens.join(open_tokens, "token")
    few = small_pairs(mixed.where(F.col("m") <= SMALL), percent)
    mixed = mixed.where(F.col("m") > SMALL).join(reps.select(F.col("rep").alias("id"), "bits"), "id")
    # blocks of like sizes: linked sets are of one kind of size or of neighbouring kinds
    kind = F.floor(F.log("n") / math.log(max(100 / percent, 1.01) * (1 + 1e-9))).cast("int")
    mixed = mixed.withColumn("kind", kind).drop("m")
    cuts = mixed.groupBy("token", "kind").agg(F.ceil(F.count(F.lit(1)) / (2 * BLOCK)).cast("int").alias("nb"))
    above = cuts.select("token", (F.col("kind") - 1).alias("kind"), F.col("nb").alias("up"))
    below = cuts.select("token", (F.col("kind") + 1).alias("kind"), F.col("nb").alias("down"))
    around = cuts.join(above, ["token", "kind"], "left").join(below, ["token", "kind"], "left").fillna(0)
    mixed = mixed.join(around, ["token", "kind"]).withColumn("block", F.pmod(F.xxhash64("id", "token"), F.col("nb")).cast("int"))
    seat = lambda k, b: F.struct(k.alias("k"), b.alias("b"))
    seats_of = lambda step, n: F.transform(F.sequence(F.lit(0), n - 1), lambda b: seat(F.col("kind") + step, b))
    none = F.array().cast("array<struct<k:int,b:int>>")
    beside = [F.when(F.col(c) > 0, seats_of(step, F.col(c))).otherwise(none) for c, step in (("up", 1), ("down", -1))]
    others = F.concat(seats_of(0, F.col("nb")), *beside)
    mixed = mixed.withColumn("own", seat(F.col("kind"), F.col("block"))).withColumn("other", F.explode(others))
    mixed = mixed.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "n", "comp", "bits")
    mixed = mixed.select("token", *(F.concat_ws("/", c + ".k", c + ".b").alias(n) for c, n in (("i", "i"), ("j", "j"), ("own", "block"))), "id", "n", "comp", "bits")
    trees = mixed.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    near_enough = few.union(candidates(trees, percent)).distinct()
    pairs = materialise(promising(near_enough, reps, percent), "pairs")
    late = materialise(verified(pairs, docs, k, percent), "links")

    found = components(same.union(near).union(late), few=FEW)
    for used in (tokens, pairs):
        dematerialise(used)
    out = rows.join(found, F.col("id") == F.col("node"), "left")
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join all of ``documents`` with itself."""
    return join_near(table(spark, sf_dir, "documents"))

"""Embedding near-duplicates by sorted projection passes.

A pass gives every vector a key of concatenated random hashes, sorts by label and
key, and compares each vector with its neighbours in a bounded window; links that
are verified (cosine in double precision) are united over all passes.  A hash is
the number, with its sign, of the random direction that a vector, less its
label's mean, points along most: so vectors with a strong common part are told
apart as well as others, while cosines are always those of the vectors themselves.

Passes come in two levels.  Few global passes are one range partitioning; its
partitions are read in blocks of ``BLOCK_BYTES`` in order.  Within a block the
rows are sorted again by further keys, whose second hash is taken less the mean
of the rows that share the first one, so that most passes cost no shuffle.
How many of each a label gets (:func:`plan`) follows from its rows and from how
close its vectors are on average; it aims at finding ``TARGET`` of the pairs at
the very threshold.  Nothing else is bounded.

Equal vectors become one class first.  Rows of equal keys are ordered by a hash
of id and pass, so that a crowd of copies is cut into other blocks by each global
pass.  Within a block the links are reduced to stars, one row per vector.

The windows bound what the passes compare, not what is counted: all links between
two vectors of one component are counted afterwards.  A component is cut into
cells of like vectors; pairs of cells whose centres and radii show that all or
none of their pairs link are settled without looking at vectors, the others are
compared.  What could be missed is only a link between vectors that no chain of
window links joins.

Defined results: vectors that are null, empty or zero, or that hold null or
non-finite components, link with nothing, nor do those with a null label or id;
vectors of different lengths do not link; repeated ids stand for one node but
come back as often as they came; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoaudit.llm._frames import col
from geoaudit.llm.jaccard import _runs
from geoaudit.operators.components import components
from geoaudit.session import materialise, table

#: Random directions of a hash, and hashes of a global pass's key.
DIRECTIONS = 64
DEPTH = 8
#: Neighbours on one side that a vector is compared with, and rows compared at once.
WINDOW = 1024
TILE = 512
#: Bytes of vectors, as doubles, that a task handles at a time.
BLOCK_BYTES = 1 << 26
#: Share of the pairs at the threshold that the passes are to find.
TARGET = 0.995
#: What a row's way through a shuffle costs, in local passes.
SHUFFLE = 3.0
#: Vectors in a cell of the exact count, and cells compared at once.
CELL = 256
GROUP = 128


def unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


def rows_of(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(v: Column) -> Column:
    """Whether a vector has a direction: neither null, empty nor zero, and all components finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def classes(df: DataFrame, id: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Usable rows ``(id, label, v)``, and ``(rep, label, v, members)``: equal vectors of a label once."""
    rows = df.select(col(id).cast("long").alias("id"), col(label).alias("label"), col(vector).alias("v")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    return rows, rows.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("members"))


def joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of nodes with the least node ``root`` that each is joined to, the same after links (i, j)."""
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def directions(dim: int, number: int, count: int) -> np.ndarray:
    """``count`` hashes' random directions, side by side; the same for equal arguments."""
    return np.random.Generator(np.random.Philox(key=[dim, number])).standard_normal((dim, count * DIRECTIONS), np.float32)


def hashed(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """For each row and hash the direction that the row points along most, with its sign."""
    along = (x.astype(np.float32) @ planes).reshape(len(x), -1, DIRECTIONS)
    top = np.abs(along).argmax(2)
    return 2 * top + (np.take_along_axis(along, top[:, :, None], 2)[:, :, 0] > 0)


def block_rows(dim: int) -> int:
    """Rows of a block."""
    return max(2 * WINDOW, min(BLOCK_BYTES // (8 * dim), 1 << 17))


def plan(n: int, common: float, least: float, room: int) -> tuple[int, int]:
    """Global passes, and sorts in each block, for a label of ``n`` vectors.

    ``common`` is the squared length of the mean of its unit vectors, ``room`` how
    many rows in order come to one block.  Less that mean, a pair at the threshold
    is at the angle ``a`` on average, and shares a hash with the odds below (an
    empirical law for DIRECTIONS); rows of one key are taken as three times as many
    as if hashes were evenly spread.
    """
    a = math.acos(min(max(1 - (1 - least) / max(1 - common, 1e-9), 0.5), 1.0))
    odds = math.exp(-a * (1.43 + 0.72 * a))

    def level(f: Callable[[float], float], rows: int) -> float:
        """Odds that a pair meets, where it does with f(m) if it shares its place with m rows."""
        alone = best = f(rows)
        shared, k = odds, 1
        while shared > 1e-6:
            best = max(best, shared * f(3 * rows / (2 * DIRECTIONS) ** k) + (1 - shared) * alone)
            shared, k = shared * odds, k + 1
        return best

    together = level(lambda m: 1 - m / (3 * room) if m <= room else room / (1.5 * m), n)
    once = level(lambda m: min(1.0, WINDOW / m), min(n, room))
    best = None
    for local in range(1, 129):
        found = together * (1 - (1 - once) ** local)
        passes = max(2, math.ceil(math.log(1 - TARGET) / math.log(1 - found))) if found < 1 else 2
        cost = passes * (SHUFFLE + local)
        if best is None or cost < best[0]:
            best = cost, passes, local
    return best[1], best[2]


class Block:
    """Vectors in order of label and key; ``join`` links those that are near in some order."""

    def __init__(self, group: np.ndarray, x: np.ndarray, least: float):
        self.code = np.cumsum(np.append(False, group[1:] != group[:-1]))
        self.x, self.flat, self.least = x, x.astype(np.float32), least
        self.root = np.arange(len(x))

    def centred(self, codes: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Rows less the mean of the run of equal codes that they are in."""
        starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        size = np.diff(np.append(starts, len(codes)))
        return x - np.repeat(np.add.reduceat(x, starts, 0) / size[:, None], size, 0)

    def sort_again(self, number: int, some: np.ndarray) -> None:
        """One more pass over the rows ``some`` by other keys."""
        if len(some) < 2:
            return
        planes = directions(self.x.shape[1], number, 2)
        rest = self.centred(self.code[some], self.x[some])
        first = self.code[some] * (2 * DIRECTIONS) + hashed(rest, planes[:, :DIRECTIONS])[:, 0]
        order = np.argsort(first, kind="stable")
        second = hashed(self.centred(first[order], rest[order]), planes[:, DIRECTIONS:])[:, 0]
        self.join(some[order[np.lexsort((second, first[order]))]])

    def join(self, order: np.ndarray) -> None:
        """Compare rows with the WINDOW rows behind them in this order."""
        xs = self.flat[order]
        apart = np.arange(TILE + WINDOW)[None, :] - np.arange(TILE)[:, None]
        window = (apart > 0) & (apart <= WINDOW)
        for t in range(0, len(order), TILE):
            a, b = xs[t : t + TILE], xs[t : t + TILE + WINDOW]
            i, j = np.nonzero((a @ b.T >= self.least - 1e-5) & window[: len(a), : len(b)])
            i, j = order[t + i], order[t + j]
            while len(i):
                open_ = (self.code[i] == self.code[j]) & (self.root[i] != self.root[j])
                i, j = i[open_], j[open_]
                # of each row one pair at a time: what it joins need not be looked at again
                _, now = np.unique(i, return_index=True)
                p, q = i[now], j[now]
                true = (self.x[p] * self.x[q]).sum(1) >= self.least
                self.root = joined(self.root, p[true], q[true])
                i, j = np.delete(i, now), np.delete(j, now)


def centres(vectors: DataFrame) -> DataFrame:
    """``(label, dim, n, centre)``: how many vectors a label has and the mean of them as unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for b in batches:
            for dim, part in by_length(b):
                x, own = unit(rows_of(part.column("v"))), part.column("label").to_numpy()
                kinds, code = np.unique(own, return_inverse=True)
                order = np.argsort(code, kind="stable")
                totals = np.add.reduceat(x[order], np.searchsorted(code[order], np.arange(len(kinds))), 0)
                for k, total, n in zip(kinds.tolist(), totals, np.bincount(code).tolist(), strict=True):
                    old = held.get((k, dim), (0, 0.0))
                    held[k, dim] = (old[0] + n, old[1] + total)
            if len(held) > 4096:
                yield flush(held)
                held.clear()
        if held:
            yield flush(held)

    def flush(held: dict) -> pa.RecordBatch:
        keys, values = list(held), list(held.values())
        columns = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()), pa.array([v[0] for v in values], pa.int64()), pa.array([v[1] for v in values], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, names=["label", "dim", "n", "total"])

    parts = vectors.select("label", "v").mapInArrow(run, "label long, dim int, n long, total array<double>")
    each = parts.select("label", "dim", "n", F.posexplode("total").alias("at", "t")).groupBy("label", "dim", "at").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    whole = each.groupBy("label", "dim").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", (F.col("t") / F.col("n")).alias("m")))).alias("c"))
    return whole.select("label", "dim", "n", F.col("c.m").alias("centre"))


def by_length(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch by the length of their vectors."""
    sizes = pc.list_value_length(b.column("v")).to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes).tolist():
        yield dim, b.filter(pa.array(sizes == dim))


def window_links(vectors: DataFrame, least: float) -> DataFrame:
    """Links ``(a, b)`` that the passes verify; ``vectors``: rep, label (long), v."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        plans: dict[tuple, tuple[int, int]] = {}
        for b in batches:
            for dim, part in by_length(b):
                x = unit(rows_of(part.column("v")))
                centre = rows_of(part.column("centre"))
                rest = x - centre
                counts, common = part.column("n").to_numpy(), (centre**2).sum(1)
                for key in set(zip(counts.tolist(), common.tolist(), strict=True)):
                    if key not in plans:
                        plans[key] = plan(key[0], key[1], least, min(room, block_rows(dim)))
                passes, local = np.array([plans[k] for k in zip(counts.tolist(), common.tolist(), strict=True)]).T
                for p in range(int(passes.max())):
                    if (dim, p) not in planes:
                        planes[dim, p] = directions(dim, p, DEPTH)
                    go = np.flatnonzero(passes > p)
                    key = np.zeros(len(go), np.int64)
                    for h in hashed(rest[go], planes[dim, p]).T:
                        key = key << 7 | h
                    some = part.take(pa.array(go))
                    yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("rep", "label", "v")), pa.array(np.full(len(go), p, np.int32)), pa.array(np.full(len(go), dim, np.int32)), pa.array(local[go].astype(np.int32)), pa.array(key)], names=["rep", "label", "v", "pass", "dim", "local", "key"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.Table | None = None
        for g, fresh in in_blocks(batches):
            rows = g if tail is None or fresh else pa.concat_tables([tail, g])
            rows = rows.combine_chunks()
            ids = rows.column("rep").to_numpy()
            number, label, local = (rows.column(c).to_numpy() for c in ("pass", "label", "local"))
            change = (number[1:] != number[:-1]) | (label[1:] != label[:-1])
            block = Block(np.cumsum(np.append(False, change)), unit(rows_of(rows.column("v").combine_chunks())), least)
            block.join(np.arange(len(ids)))
            for k in range(1, int(local.max())):
                block.sort_again(1000 + k, np.flatnonzero(local > k))
            far = np.flatnonzero(block.root != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[block.root[far]])], names=["a", "b"])
            tail = rows.slice(max(0, len(ids) - WINDOW))

    element = vectors.schema["v"].dataType.simpleString()
    middle = materialise(centres(vectors), "centres")
    about = vectors.select("rep", "label", "v", F.size("v").alias("dim")).join(middle, ["label", "dim"])
    rows, size = middle.agg(F.sum("n"), F.sum(F.col("n") * F.col("dim"))).first()
    spark = vectors.sparkSession
    # blocks as large as they may be, but work for all cores; two passes are the least
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * (size or 0) * 8 // BLOCK_BYTES))
    room = max(2 * (rows or 0) // parts, 2)
    keyed = about.select("rep", "label", "v", "n", "centre").mapInArrow(keys, f"rep long, label long, v {element}, pass int, dim int, local int, key long")
    order = [F.col(c) for c in ("dim", "pass", "label", "key")] + [F.xxhash64("rep", "pass")]
    return keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(compare, "a long, b long").distinct()


def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool]]:
    """Rows in order, a block at most at a time and of one length, and whether the length is new."""
    held: list[pa.RecordBatch] = []
    count, last, fresh = 0, None, True
    for b in batches:
        sizes = b.column("dim").to_numpy()
        cuts = [0, *(np.flatnonzero(sizes[1:] != sizes[:-1]) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            while lo < hi:
                if held and (sizes[lo] != last or count >= block_rows(last)):
                    yield pa.Table.from_batches(held), fresh
                    fresh = sizes[lo] != last
                    held, count = [], 0
                n = min(hi - lo, block_rows(int(sizes[lo])) - count)
                held.append(b.slice(lo, n))
                count, last, lo = count + n, sizes[lo], lo + n
    if held:
        yield pa.Table.from_batches(held), fresh


def cells(members: DataFrame) -> DataFrame:
    """``members`` with ``cell``: like vectors of a component together, some ``CELL`` in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, part in by_length(b):
                if dim not in planes:
                    planes[dim] = directions(dim, 0, 1)
                h = hashed(unit(rows_of(part.column("v"))), planes[dim])[:, 0]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(h.astype(np.int32))], names=[*part.schema.names, "h"])

    marked = members.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema.fields) + ", h int")
    # at most twice DIRECTIONS kinds a component: sparse ones share cells, crowded ones have several
    kinds = marked.groupBy("component", "h").agg(F.count(F.lit(1)).alias("m"))
    before = F.sum("m").over(Window.partitionBy("component").orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
    kinds = kinds.withColumn("start", F.floor(F.coalesce(before, F.lit(0)) / CELL)).withColumn("parts", F.ceil(F.col("m") / CELL).cast("int"))
    crowded = F.concat_ws("-", "h", F.pmod(F.xxhash64("rep"), F.col("parts")))
    cell = F.when(F.col("parts") > 1, crowded).otherwise(F.concat(F.lit("s"), F.col("start")))
    return marked.join(kinds, ["component", "h"]).withColumn("cell", cell).drop("h", "m", "start", "parts")


def settle(shapes: DataFrame, least: float) -> DataFrame:
    """``(component, i, j, links)`` for pairs of cells, ``links`` -1 where vectors must be compared.

    ``shapes``: component, cell, centre, radius, weight; pairs without any link do
    not appear; those of which every pair links have the weight that ``i`` gains
    from ``j``, and ``j``'s gain from ``i`` is a row of its own.
    """
    wide = math.acos(least)
    keys = ["component", "x", "y"]
    sizes = shapes.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts"))
    cut = shapes.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("cell"), F.col("parts")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = cut.select("component", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "cell", "centre", "radius", "weight")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _runs(batches, keys):
            g = g.combine_chunks()
            x, y = g.column("x")[0].as_py(), g.column("y")[0].as_py()
            own, name = g.column("own").to_numpy(), np.asarray(g.column("cell").to_pylist(), dtype=object)
            centre, radius, weight = rows_of(g.column("centre").combine_chunks()), g.column("radius").to_numpy(), g.column("weight").to_numpy()
            left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
            angle = np.arccos(np.clip(centre[left] @ centre[right].T, -1, 1))
            reach = radius[left][:, None] + radius[right][None, :]
            inside, maybe = angle + reach <= wide - 1e-6, angle - reach <= wide + 1e-6
            if x == y:
                np.fill_diagonal(maybe, True)
                # a cell with itself: all of its pairs are within twice the radius
                np.fill_diagonal(inside, 2 * radius[left] <= wide - 1e-6)
                maybe &= name[left][:, None] <= name[right][None, :]
            i, j = np.nonzero(maybe & ~inside)
            p, q = np.nonzero(inside)
            one, two = [name[left[i]], name[left[p]]], [name[right[j]], name[right[q]]]
            gain = [np.full(len(i), -1), weight[right[q]]]
            if x != y:
                one, two, gain = [*one, name[right[q]]], [*two, name[left[p]]], [*gain, weight[left[p]]]
            one, two = (np.concatenate(k) for k in (one, two))
            yield pa.RecordBatch.from_arrays([pa.array([g.column("component")[0].as_py()] * len(one), pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string()), pa.array(np.concatenate(gain), pa.int64())], names=["component", "i", "j", "links"])

    return cut.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "component long, i string, j string, links long")


def count_links(members: DataFrame, least: float) -> DataFrame:
    """``(rep, n)``: weight of the vectors that each one links with; ``members``: component, rep, v, members.

    A component lies within one label and one length of vectors.
    """
    placed = materialise(cells(members), "cells")

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _runs(batches, ["component", "cell"]):
            x = unit(rows_of(g.column("v").combine_chunks()))
            centre = x.sum(0)
            norm = np.sqrt((centre**2).sum())
            centre = centre / norm if norm > 1e-9 else x[0]
            radius = float(np.arccos(np.clip((x @ centre).min(), -1, 1))) + 1e-7
            yield pa.RecordBatch.from_arrays([pa.array([g.column("component")[0].as_py()], pa.int64()), pa.array([g.column("cell")[0].as_py()], pa.string()), pa.array([centre], pa.list_(pa.float64())), pa.array([radius]), pa.array([int(g.column("members").to_numpy().sum())], pa.int64())], names=["component", "cell", "centre", "radius", "weight"])

    by = ["component", "cell"]
    shapes = placed.repartition(*by).sortWithinPartitions(*by).mapInArrow(shape, "component long, cell string, centre array<double>, radius double, weight long")
    pairs = materialise(settle(shapes, least), "pairs")
    # settled: a member gains the other cell's weight, or its own cell's less its own
    gains = pairs.where("links >= 0").groupBy("component", F.col("i").alias("cell")).agg(F.sum("links").alias("n"), F.max((F.col("i") == F.col("j")).cast("int")).alias("same"))
    settled = placed.join(gains, by).select("rep", (F.col("n") - F.when(F.col("same") == 1, F.col("members")).otherwise(0)).alias("n"))
    keys = ["component", "i", "j"]
    left = pairs.where("links < 0").select("component", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("cell"))
    cut = placed.join(left, by).select(*keys, "cell", "rep", "members", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _runs(batches, keys):
            g = g.combine_chunks()
            i, j = g.column("i")[0].as_py(), g.column("j")[0].as_py()
            cell, ids, weight = np.asarray(g.column("cell").to_pylist(), dtype=object), g.column("rep").to_numpy(), g.column("members").to_numpy()
            x = unit(rows_of(g.column("v").combine_chunks()))
            left, right = np.flatnonzero(cell == i), np.flatnonzero(cell == j)
            product = x[left] @ x[right].T
            hit = product >= least
            # the product's last bits differ from a plain sum's: decide near ties by that
            for p, q in np.argwhere(np.abs(product - least) < 1e-12):
                hit[p, q] = (x[left[p]] * x[right[q]]).sum() >= least
            if i == j:
                np.fill_diagonal(hit, False)
                n, who = hit @ weight[right], ids[left]
            else:
                n, who = np.concatenate([hit @ weight[right], weight[left] @ hit]), np.concatenate([ids[left], ids[right]])
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(n, pa.int64())], names=["rep", "n"])

    compared = cut.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "rep long, n long")
    return settled.union(compared).groupBy("rep").agg(F.sum("n").alias("n"))


def near_duplicates(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98) -> DataFrame:
    """Per row ``id``, ``n_links``, ``component_id`` and ``kept``.

    ``component_id`` is the least id reachable by links, the row's own included;
    ``kept`` says whether that is the row's own.
    """
    rows, once = classes(df, id, vector, label)
    once = materialise(once, "classes")
    code = F.col("label").cast("long") if once.schema["label"].dataType.typeName() in ("byte", "short", "integer", "long") else F.xxhash64("label")
    vectors = once.select("rep", code.alias("label"), "v", "members")
    found = materialise(components(window_links(vectors, least)), "components")
    grouped = vectors.join(found, F.col("rep") == F.col("node")).select("component", "rep", "v", "members")
    counted = count_links(grouped, least)
    known = once.select("rep", "label", "v", "members").join(found, F.col("rep") == F.col("node"), "left").drop("node").join(counted, "rep", "left")
    known = known.select("label", "v", F.coalesce("component", "rep").alias("c"), (F.coalesce("n", F.lit(0)) + F.col("members") - 1).alias("n_links"))
    linked = rows.join(known, ["label", "v"]).select("id", F.col("n_links").cast("long").alias("n_links"), "c")
    rest = df.select(col(id).cast("long").alias("id"), col(vector).alias("v"), col(label).alias("label"))
    alone = rest.where(~usable(F.col("v")) | F.col("id").isNull() | F.col("label").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("c"))
    done = linked.union(alone)
    return done.select(F.col("id").alias(id), "n_links", F.col("c").alias("component_id"), (F.col("id") == F.col("c")).alias("kept"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``embeddings``, within equal labels, at a cosine of 0.98."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))

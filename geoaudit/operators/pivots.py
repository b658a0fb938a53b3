"""Nearest neighbours by metric pivots: cells of like vectors that prove each other far.

A bounded number of pivots is drawn from the vectors by hash.  Vectors are ordered by
nearest pivot and distance from it and cut, partition by partition, into cells of at
most ``CELL`` and packs of at most ``PACK``; a cell keeps the interval of its vectors'
distances to every pivot.  By the triangle inequality two cells are at least as far
apart as their intervals for any pivot, so a cell whose vectors have all found ``k``
nearer neighbours never meets the other one.  Vectors travel as cells (one row each),
and only to the packs that need them; pairs of cells are never made of pairs of rows.

Vectors of different lengths do not meet; rows with a null id, a null vector or null
components are in no cell.  Crowds of equal vectors are cut by their ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoaudit.operators import blocks
from geoaudit.session import materialise

#: Most pivots, vectors in a cell and in a pack, and cells whose bounds are compared at once.
PIVOTS = 256
CELL = 512
PACK = 4096
SHEET = 1024
#: Packs' worth of asking and of known vectors that one task compares.
ASKING, KNOWN = 4, 8

_CELLS = "cell long, pack long, dim int, ids array<long>, asked array<boolean>, known array<boolean>, v binary, lo array<double>, hi array<double>"


@dataclass
class Cells:
    """Cells of vectors, one row each, and the pivots (ids and vectors) that bound them."""

    table: DataFrame
    pivots: list[tuple[int, np.ndarray]]


def _vectors(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), dim)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances of two small sets, by differences where products would round."""
    d, slack = blocks.squared(x, y)
    a, b = np.nonzero(d <= 1e4 * slack[:, None])
    d[a, b] = blocks.exact(x, y, a, b)
    return np.sqrt(d, out=d)


def build(points: DataFrame, key: str = "id", vector: str = "v", asked: str | None = None, known: str | None = None) -> Cells:
    """Cells of all vectors; ``asked`` and ``known`` name flags of the rows that ask and that may be found (all, if not given)."""
    flag = lambda c: F.lit(True) if c is None else F.col(c)
    v = F.col(vector).cast("array<double>")
    x = points.where(F.col(key).isNotNull() & v.isNotNull()).where(~F.exists(v, lambda e: e.isNull()))
    x = x.select(F.col(key).cast("long").alias("id"), v.alias("v"), F.size(v).alias("dim"), flag(asked).alias("asked"), flag(known).alias("known"))
    n = x.count()
    drawn = x.orderBy(F.xxhash64("id"), "id").limit(max(1, min(PIVOTS, int(n**0.5)))).select("id", "v").collect()  # a bounded number
    pivots = [(r.id, np.array(r.v, np.float64)) for r in drawn]

    def of(dim: int) -> np.ndarray:
        mine = [p for _, p in pivots if len(p) == dim]
        return np.array(mine, np.float64).reshape(len(mine), dim)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim in np.unique(b.column("dim").to_numpy()).tolist():
                part = b.filter(pc.equal(b.column("dim"), dim))
                mine, m = _vectors(part.column("v"), dim), of(dim)
                d = distances(mine, m) if len(m) else np.zeros((len(mine), 1))
                at = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(at, pa.int32()), pa.array(d[np.arange(len(at)), at])], names=[*part.schema.names, "pivot", "r"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, cell, pack, filled, last = TaskContext.get().partitionId() << 32, -1, 0, 0, None
        held: list[dict] = []

        def flush() -> pa.RecordBatch:
            dim = held[0]["dim"]
            v, m = np.array([r["v"] for r in held], np.float64).reshape(len(held), dim), of(dim)
            d = distances(v, m) if len(m) else np.zeros((len(v), 0))
            bytes_ = [pa.array([base + cell]), pa.array([base + pack]), pa.array([dim], pa.int32())]
            lists = [pa.array([[r["id"] for r in held]], pa.list_(pa.int64())), *(pa.array([[r[c] for r in held]], pa.list_(pa.bool_())) for c in ("asked", "known"))]
            return pa.RecordBatch.from_arrays([*bytes_, *lists, pa.array([v.tobytes()], pa.binary()), *(pa.array([z.tolist()], pa.list_(pa.float64())) for z in (d.min(0), d.max(0)))], names=["cell", "pack", "dim", "ids", "asked", "known", "v", "lo", "hi"])

        for b in batches:
            for row in b.to_pylist():
                now = (row["dim"], row["pivot"])
                if held and (now != last or len(held) == CELL):
                    yield flush()
                    held.clear()
                if not held:
                    cell += 1
                    if filled + CELL > PACK or (last is not None and last[0] != now[0]):
                        pack, filled = pack + 1, 0
                filled += 1
                held.append(row)
                last = now
        if held:
            yield flush()

    rows = x.mapInArrow(placed, "id long, v array<double>, dim int, asked boolean, known boolean, pivot int, r double")
    ordered = rows.repartitionByRange("dim", "pivot", "r", "id").sortWithinPartitions("dim", "pivot", "r", "id")
    return Cells(materialise(ordered.mapInArrow(cut, _CELLS), "cells"), pivots)


def needed(asking: DataFrame, cells: DataFrame, own: bool = False) -> DataFrame:
    """``(a, pa, b, pb)``: cells that their pivots do not prove to be farther apart than ``reach`` of the asking one; of one pack only with ``own``.

    ``asking`` has ``cell, pack, dim, lo, hi, reach`` (a distance).
    """

    def run(t: pa.Table, o: pa.Table) -> pa.Table:
        out = []
        if t.num_rows and o.num_rows:
            wide = lambda c, x: np.array(x.column(c).to_pylist(), np.float64).reshape(x.num_rows, -1)
            lo, hi, olo, ohi = wide("lo", t), wide("hi", t), wide("lo", o), wide("hi", o)
            far = np.zeros((len(lo), len(olo)))
            for p in range(lo.shape[1]):
                np.maximum(far, lo[:, p, None] - ohi[None, :, p], out=far)
                np.maximum(far, olo[None, :, p] - hi[:, p, None], out=far)
            reach = t.column("reach").to_numpy()
            # distances of large vectors are rounded
            slack = 1e-9 * (1 + (hi.max(1) if hi.shape[1] else np.zeros(len(hi))))
            near = far <= (reach + slack)[:, None]
            if not own:
                near &= t.column("pack").to_numpy()[:, None] != o.column("pack").to_numpy()[None, :]
            a, b = np.nonzero(near)
            out = [t.column("cell").to_numpy()[a], t.column("pack").to_numpy()[a], o.column("cell").to_numpy()[b], o.column("pack").to_numpy()[b]]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("a", "pa", "b", "pb"), out or [[]] * 4, strict=True)})

    n = max(1, -(-cells.count() // SHEET))
    mine = lambda: F.pmod(F.xxhash64("cell"), F.lit(n)).cast("int")
    every = lambda: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asking.select("cell", "pack", "dim", "lo", "hi", "reach", mine().alias("i"), every().alias("j"))
    right = cells.select("cell", "pack", "dim", "lo", "hi").toDF("cell", "pack", "dim", "lo", "hi").select("*", every().alias("i"), mine().alias("j"))
    return left.groupBy("i", "j", "dim").cogroup(right.groupBy("i", "j", "dim")).applyInArrow(run, "a long, pa long, b long, pb long")


def _rows(t: pa.Table) -> Iterator[dict]:
    """Rows as dicts, lists as arrays."""
    lists = {c for c in t.column_names if pa.types.is_list(t.schema.field(c).type)}
    for i in range(t.num_rows):
        yield {c: t.column(c)[i].values.to_numpy(zero_copy_only=False) if c in lists else t.column(c)[i].as_py() for c in t.column_names}


def met(asking: DataFrame, cells: DataFrame, needs: DataFrame, f: Callable[[dict, list[dict]], pa.Table | None], schema: str, empty: pa.Table) -> DataFrame:
    """``f`` of each asking cell (a dict of its columns) and the cells that it needs of some packs, wherever they are.

    A task has about ``ASKING`` packs' worth of asking cells (less if there would be
    fewer tasks than cores) and those of about ``KNOWN`` packs' worth that any of them
    needs.
    """

    def run(t: pa.Table, o: pa.Table) -> pa.Table:
        others = {r["cell"]: r for r in _rows(o)}
        found = [f(r, [others[b] for b in r["wanted"].tolist()]) for r in _rows(t)]
        return pa.concat_tables([empty, *(x for x in found if x is not None)])

    n = cells.agg(F.sum(F.size("ids"))).first()[0] or 0
    asked = max(-(-n // (ASKING * PACK)), cells.sparkSession.sparkContext.defaultParallelism)
    tile = lambda c, k: F.pmod(F.xxhash64(c), F.lit(max(1, k)))
    needs = needs.select("a", "b", tile("pa", asked).alias("ta"), tile("pb", -(-n // (KNOWN * PACK))).alias("tb"))
    bounds = ("lo", "hi", "reach", "pack")
    asks = needs.groupBy("a", "ta", "tb").agg(F.collect_list("b").alias("wanted"))  # as many as the packs have cells
    left = asks.join(asking.drop(*bounds), F.col("a") == F.col("cell")).drop("a")
    sent = needs.select("b", "ta", "tb").distinct()
    right = sent.join(cells.drop(*bounds).toDF(*(c for c in cells.columns if c not in bounds)), F.col("b") == F.col("cell")).drop("b")
    right = right.toDF(*right.columns)  # both sides come from the same frames: fresh columns
    return left.groupBy("ta", "tb").cogroup(right.groupBy("ta", "tb")).applyInArrow(run, schema)


_FOUND = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("d", pa.float64())])
_NEAR = "i long, j long, d double"


def matrix(cell: dict) -> np.ndarray:
    return np.frombuffer(cell["v"], np.float64).reshape(-1, cell["dim"]) if cell["dim"] else np.zeros((len(cell["ids"]), 0))


def closest(cell: dict, others: list[dict], k: int, limit: np.ndarray) -> pa.Table | None:
    """For each asking vector the k nearest known ones of ``others``, none beyond its limit; squared distances at 12 decimals, ties by id."""
    asked = np.flatnonzero(cell["asked"])
    known = [np.flatnonzero(o["known"]) for o in others]
    names = np.concatenate([o["ids"][w] for o, w in zip(others, known, strict=True)]) if others else np.zeros(0, np.int64)
    if not len(asked) or not len(names):
        return None
    x, ids, limit = matrix(cell)[asked], cell["ids"][asked], limit[asked]
    y = np.concatenate([matrix(o)[w] for o, w in zip(others, known, strict=True)])
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    place = np.argsort(names, kind="stable")
    own = np.minimum(np.searchsorted(names[place], ids), len(names) - 1)
    own = np.where(names[place[own]] == ids, place[own], -1)  # where a vector meets itself
    out, rows = [], max(16, min(blocks.ROWS, (1 << 21) // len(y)))
    for lo in range(0, len(x), rows):
        part, at = x[lo : lo + rows], slice(lo, lo + rows)
        d = part @ y.T  # squared distances less that of the asking vector from the origin
        d *= -2
        d += yy
        slack = 2e-12 * (xx[at] + yy.max()) + 2e-12
        top = limit[at] - xx[at]
        wide = np.flatnonzero(~np.isfinite(top))
        if len(wide):  # nothing is known yet: the k least, and one more for the vector itself
            kth = min(k + 1, len(y)) - 1
            top[wide] = np.partition(d[wide], kth, axis=1)[:, kth]
        a, b = np.nonzero(d <= (top + slack)[:, None])
        other = own[at][a] != b
        a, b = a[other], b[other]
        e = np.round(blocks.exact(part, y, a, b), 12)
        order = np.lexsort((names[b], e, a))
        a, b, e = a[order], b[order], e[order]
        few = np.arange(len(a)) - np.searchsorted(a, a) < k
        out.append((ids[a[few] + lo], names[b[few]], e[few]))
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=_FOUND)


def knn(cells: Cells, k: int) -> DataFrame:
    """``(i, j, d, rank)``: of every asking vector the k nearest known ones (not itself), by squared distance, then id.

    First every pack looks among its own vectors; what a vector has then found bounds
    how far it must look, and the second pass compares the cells that are not proven
    to be farther away.
    """
    found = materialise(_own(cells, k), "near")
    ranked = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    reach = found.withColumn("rank", ranked).where(F.col("rank") == k).select("i", F.col("d").alias("limit"))
    rows = cells.table.select("cell", F.posexplode(F.arrays_zip("ids", "asked")).alias("at", "r")).select("cell", "at", F.col("r.ids").alias("i"), F.col("r.asked").alias("asked"))
    limits = rows.join(reach, "i", "left").select("cell", "at", F.when(F.col("asked"), F.coalesce("limit", F.lit(float("inf")))).otherwise(F.lit(-1.0)).alias("limit"))
    by_cell = limits.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "limit"))), lambda s: s["limit"]).alias("limit"), F.sqrt(F.max("limit")).alias("reach")).where("reach >= 0")
    asking = materialise(cells.table.join(by_cell, "cell"), "asking")
    needs = materialise(needed(asking, cells.table), "needs")
    more = met(asking, cells.table, needs, lambda c, others: closest(c, others, k, c["limit"]), _NEAR, _FOUND.empty_table())
    return found.union(more).withColumn("rank", ranked).where(F.col("rank") <= k)


def _own(cells: Cells, k: int) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        rows = list(_rows(t))
        found = [closest(r, rows, k, np.full(len(r["ids"]), np.inf)) for r in rows]
        return pa.concat_tables([_FOUND.empty_table(), *(x for x in found if x is not None)])

    return cells.table.groupBy("pack").applyInArrow(run, _NEAR)

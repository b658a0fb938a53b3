"""Gradient boosting of leaf-wise trees over histograms.

Values become bins once.  Of a tree's nodes Spark adds up histograms (gradient,
hessian and rows by node, feature and bin): one aggregate for all nodes that are
asked in a round.  Only the child with fewer rows is asked, its sibling is the parent
less the child.  A tree grows where the gain is greatest until it has ``leaves``
leaves; what a node gains does not depend on the order of growth, so a round asks for
all nodes that growth would reach with what is known, and the rounds of a tree are no
more than its depth.  Missing values have a bin of their own and go to the side that
gains more.

Defined results: rows with a null label are left out of the fit; a null or NaN value
is missing; a feature without values never splits; weights are 1 where there is no
weight column, null weights count 0; one label only, or no rows, gives a constant.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoaudit.session import dematerialise, materialise

#: Bin of missing values.
MISSING = 255


@dataclass
class Node:
    """A leaf until it is split: ``feature`` and the last bin that goes left."""

    gradient: float
    hessian: float
    rows: int
    feature: int = -1
    bin: int = -1
    missing_left: bool = False
    gain: float = 0.0
    left: int = -1
    right: int = -1
    value: float = 0.0


@dataclass
class Model:
    """Cut points of the features, the first score, and the trees."""

    features: list[str]
    edges: list[list[float]]
    base: float
    trees: list[list[Node]] = field(default_factory=list)


def routed(bins: np.ndarray, tree: list[Node]) -> np.ndarray:
    """The node of a tree that each row of bins ends in."""
    at = np.zeros(len(bins), np.int32)
    for i, n in enumerate(tree):  # children come after their parents
        if n.left >= 0:
            here = np.flatnonzero(at == i)
            b = bins[here, n.feature]
            left = np.where(b == MISSING, n.missing_left, b <= n.bin)
            at[here] = np.where(left, n.left, n.right)
    return at


def best_split(h: np.ndarray, l2: float, least: int) -> tuple[float, int, int, bool]:
    """``(gain, feature, bin, missing left)`` of a node's histogram (feature x bin x (gradient, hessian, rows)).

    The first of equal gains (at nine decimals) in the order of features, then
    missing values on the right, then bins.
    """
    total = h[0].sum(0)
    score = lambda g, e: g * g / (e + l2)
    best = (0.0, -1, -1, False)
    for f in range(len(h)):
        missing = h[f, MISSING]
        upto = np.cumsum(h[f, :MISSING], 0)[:-1]
        for side in (False, True) if missing[2] else (False,):
            left = upto + missing if side else upto
            right = total - left
            ok = (left[:, 2] >= least) & (right[:, 2] >= least) & (left[:, 1] > 1e-12) & (right[:, 1] > 1e-12)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, score(left[:, 0], left[:, 1]) + score(right[:, 0], right[:, 1]) - score(total[0], total[1]), -np.inf)
            at = int(np.argmax(np.round(gain, 9)))
            if gain[at] > best[0] + 1e-9:
                best = (float(gain[at]), f, at, side)
    return best


def _binned(df: DataFrame, model: Model, more: list[str]) -> DataFrame:
    """Rows with ``bins`` (one byte for each feature) and some of their columns."""
    at = []
    for f, edges in zip(model.features, model.edges, strict=True):
        x = F.col(f).cast("double")
        place = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < x)) if edges else F.lit(0)  # noqa: B023
        at.append(F.when(x.isNull() | F.isnan(x), F.lit(MISSING)).otherwise(place).cast("int"))
    return df.select(*more, F.array(*at).alias("bins"))


def _bins(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int16).reshape(len(column), width)


def _slopes(y: np.ndarray, w: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-f))
    return w * (p - y), w * p * (1 - p)


def _histograms(rows: DataFrame, tree: list[Node], asked: list[int], width: int) -> dict[int, np.ndarray]:
    """Histograms of the asked nodes: added up in the tasks, then by Spark."""
    where = {n: k for k, n in enumerate(asked)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros((len(asked) * width * 256, 3))
        for b in batches:
            bins = _bins(b.column("bins"), width)
            y, w, f = (b.column(c).to_numpy() for c in ("y", "w", "f"))
            g, h = _slopes(y, w, f)
            place = np.array([where.get(n, -1) for n in range(len(tree))])[routed(bins, tree)]
            for j in range(width):
                mine = np.flatnonzero(place >= 0)
                cell = (place[mine] * width + j) * 256 + bins[mine, j]
                for k, v in enumerate((g, h)):
                    got[:, k] += np.bincount(cell, v[mine], minlength=len(got))
                got[:, 2] += np.bincount(cell, minlength=len(got))
        full = np.flatnonzero(got[:, 2])
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *(pa.array(got[full, k]) for k in range(3))], names=["cell", "g", "h", "n"])

    added = rows.mapInArrow(run, "cell int, g double, h double, n double").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    out = np.zeros((len(asked), width, 256, 3))
    for r in added.collect():  # nodes x features x bins
        out.reshape(-1, 3)[r.cell] = (r.g, r.h, r.n)
    return {n: out[k] for k, n in enumerate(asked)}


def grown(rows: DataFrame, width: int, leaves: int, l2: float, least: int) -> list[Node]:
    """One tree over ``rows`` (``bins, y, w, f``)."""
    known: dict[int, np.ndarray] = {}
    root = _histograms(rows, [Node(0, 0, 0)], [0], width)[0]
    tree: list[Node] = []

    def add(h: np.ndarray) -> int:
        g, e, n = h[0].sum(0)
        node = Node(float(g), float(e), int(n))
        node.gain, node.feature, node.bin, node.missing_left = best_split(h, l2, least)
        tree.append(node)
        known[len(tree) - 1] = h
        return len(tree) - 1

    def open_(i: int) -> None:
        """Room for a node's children, before their histograms are known."""
        tree[i].left, tree[i].right = len(tree), len(tree) + 1
        tree.extend([Node(0, 0, 0), Node(0, 0, 0)])

    add(root)
    while True:
        # growth with what is known: the nodes it would split whose children are not known yet
        heap, wanted, split, n = [(-round(tree[0].gain, 9), 0)], [], [], 1
        while heap and n < leaves:
            gain, i = heapq.heappop(heap)
            if gain >= 0:
                continue
            split.append(i)
            n += 1
            if tree[i].left < 0:
                wanted.append(i)
                continue
            for c in (tree[i].left, tree[i].right):
                heapq.heappush(heap, (-round(tree[c].gain, 9), c))
        if not wanted:
            break
        small = {}
        for i in wanted:
            open_(i)
            h, t = known[i][tree[i].feature], tree[i]
            left = h[: t.bin + 1, 2].sum() + (h[MISSING, 2] if t.missing_left else 0)
            small[i] = t.left if 2 * left <= t.rows else t.right
        found = _histograms(rows, tree, list(small.values()), width)
        for i, c in small.items():
            other = tree[i].left + tree[i].right - c
            for node, h in ((c, found[c]), (other, known[i] - found[c])):
                h[..., 2] = np.round(h[..., 2])
                g, e, k = h[0].sum(0)
                t = tree[node] = Node(float(g), float(e), int(k))
                t.gain, t.feature, t.bin, t.missing_left = best_split(h, l2, least)
                known[node] = h
            del known[i]
    # nodes that were asked ahead of growth but not reached go
    kept, out = set(split), []

    def copy(i: int) -> int:
        t, k = tree[i], len(out)
        out.append(Node(t.gradient, t.hessian, t.rows, value=-t.gradient / (t.hessian + l2) if t.hessian + l2 > 0 else 0.0))
        if i in kept:
            out[k].feature, out[k].bin, out[k].missing_left, out[k].gain = t.feature, t.bin, t.missing_left, t.gain
            out[k].left = copy(t.left)
            out[k].right = copy(t.right)
        return k

    copy(0)
    return out


def fit(df: DataFrame, features: list[str], label: str = "y", weight: str | None = None, rounds: int = 100, leaves: int = 31, rate: float = 0.1, l2: float = 0.0, least: int = 20, bins: int = 255) -> Model:
    """Boosted trees for a label of 0 and 1 under the logistic loss.

    A feature is cut at up to ``bins - 1`` of its quantiles.
    """
    known = df.where(F.col(label).isNotNull())
    cuts = known.agg(*(F.percentile_approx(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), [i / bins for i in range(1, bins)], 10_000).alias(f"q{i}") for i, f in enumerate(features))).first()
    w = F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    model = Model(features, [sorted(set(c or [])) for c in cuts], 0.0)
    rows = _binned(known.select("*", F.col(label).cast("double").alias("__y"), w.alias("__w")), model, ["__y", "__w"]).withColumnsRenamed({"__y": "y", "__w": "w"})
    total, ones = known.agg(F.sum(w), F.sum(w * F.col(label).cast("double"))).first()
    if not total or not ones or ones >= total:
        model.base = 0.0 if not total else (-40.0 if not ones else 40.0)
        return model
    model.base = math.log(ones / (total - ones))
    rows = materialise(rows.withColumn("f", F.lit(model.base)), "rows")
    for turn in range(rounds):
        tree = grown(rows, len(features), leaves, l2, least)
        for n in tree:
            n.value *= rate
        model.trees.append(tree)
        if turn + 1 < rounds:
            after = materialise(_added(rows, [tree], len(features)), "rows")
            dematerialise(rows)
            rows = after
    return model


def _added(rows: DataFrame, trees: list[list[Node]], width: int) -> DataFrame:
    """Rows with ``f`` increased by the trees' values."""
    at = rows.columns.index("f")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins, f = _bins(b.column("bins"), width), b.column("f").to_numpy().copy()
            for tree in trees:
                f += np.array([n.value for n in tree])[routed(bins, tree)]
            yield b.set_column(at, "f", pa.array(f))

    return rows.mapInArrow(run, rows.schema)


def score(df: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """Append the probability of label 1."""
    kept = [c for c in df.columns if c != name]
    packed = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), *(F.col(f"`{f}`").alias(f) for f in model.features))
    rows = _binned(packed, model, ["row"]).withColumn("f", F.lit(float(model.base)))
    done = _added(rows, model.trees, len(model.features)) if model.trees else rows
    return done.select("row.*", (1 / (1 + F.exp(-F.col("f")))).alias(name))

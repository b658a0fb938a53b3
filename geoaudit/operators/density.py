"""Density clustering: mutual reachability, a minimum spanning forest, the condensed tree and its most stable clusters.

A point's core distance is that of its ``samples``-th neighbour, itself included; two
points are as far apart as the greatest of both core distances and their distance.

The forest grows by Boruvka rounds.  A component takes the least edge out of the
neighbour lists of its points; the edge is proven if no point of the component has a
list that ends before it.  Only when too few components have proven edges are vectors
compared again: then points whose lists end too early look among the cells that pivots
do not prove to be farther than the component's best edge so far; the largest component
never looks, since its least edge to another one is found from there.

The hierarchy comes from the forest by halving: the lighter half of a problem's edges
makes components, which are problems of their own, and in the heavier half each of
them is one node.  A problem with at most ``LOCAL`` edges is solved in one task, one
whose edges all weigh the same by counting.  Components below ``size`` points have no
inner structure to report.  Equal weights merge at once, so ties have one outcome
whatever the forest.  Clusters are then chosen from the leaves up: one stays if it is
at least as stable as its descendants together; a root never does.

Defined results: ids are integers and unique; rows with a null id, vector or component
are left out; vectors of different lengths are never in one cluster; distances below
``LEAST`` count as ``LEAST`` (copies would be infinitely stable); an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoaudit.operators import blocks, pivots
from geoaudit.operators.components import components
from geoaudit.session import materialise

#: Neighbours in a list at least, and edges that one task may solve.
NEIGHBOURS = 8
LOCAL = 1 << 15
LEAST = 1e-9

_EDGE = "w double, a long, b long"
_CANDIDATE = f"ca long, cb long, {_EDGE}"
_CANDIDATES = pa.schema([("ca", pa.int64()), ("cb", pa.int64()), ("w", pa.float64()), ("a", pa.int64()), ("b", pa.int64())])


def reachability(cells: pivots.Cells, samples: int) -> tuple[DataFrame, DataFrame]:
    """``(id, core, radius)`` of every point, and the edges ``(a, b, w)`` of the neighbour lists."""
    k = max(NEIGHBOURS, samples - 1)
    near = materialise(pivots.knn(cells, k), "neighbours")
    some = near.groupBy("i").agg(F.max(F.when(F.col("rank") < samples, F.sqrt("d"))).alias("core"), F.max(F.when(F.col("rank") == k, F.sqrt("d"))).alias("radius"))
    ids = cells.table.select(F.explode("ids").alias("id"))
    # a list that is not full holds all there is
    points = ids.join(some, F.col("id") == F.col("i"), "left").select("id", F.coalesce("core", F.lit(0.0)).alias("core"), F.coalesce("radius", F.lit(float("inf"))).alias("radius"))
    points = materialise(points, "points")
    core = lambda c: points.select(F.col("id").alias(c), F.col("core").alias(f"core_{c}"))
    w = F.greatest(F.sqrt("d"), "core_i", "core_j", F.lit(LEAST))
    edges = near.join(core("i"), "i").join(core("j"), "j").select(F.col("i").alias("a"), F.col("j").alias("b"), w.alias("w"))
    return points, materialise(edges, "edges")


def _dressed(cells: pivots.Cells, state: DataFrame) -> DataFrame:
    """Cells with the component, core distance and list end of each of their vectors."""
    rows = cells.table.select("cell", F.posexplode("ids").alias("at", "id")).join(state, "id")
    listed = rows.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("at", "comp", "core", "radius"))).alias("x"))
    take = lambda c: F.transform("x", lambda s: s[c]).alias(c)
    return cells.table.join(listed.select("cell", take("comp"), take("core"), take("radius")), "cell")


def _least(rows: np.ndarray, columns: np.ndarray, w: np.ndarray, mine: tuple[np.ndarray, np.ndarray], theirs: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    """Of edges between rows and columns the least one of each component of the rows."""
    (ids, comps), (names, others) = mine, theirs
    order = np.lexsort((np.maximum(ids[rows], names[columns]), np.minimum(ids[rows], names[columns]), w, comps[rows]))
    c = comps[rows][order]
    first = order[np.concatenate(([True], c[1:] != c[:-1]))] if len(order) else order
    return pa.table([comps[rows[first]], others[columns[first]], w[first], ids[rows[first]], names[columns[first]]], schema=_CANDIDATES)


def _to_pivots(dressed: DataFrame, cells: pivots.Cells, state: DataFrame) -> DataFrame:
    """An edge of every component to the nearest pivot of another one, and the reverse of it."""
    vectors = cells.pivots
    drawn = {r.id: r for r in state.where(F.col("id").isin([i for i, _ in vectors])).collect()}  # as many as there are pivots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell in b.to_pylist():
                own = [(i, v) for i, v in vectors if len(v) == cell["dim"]]
                x = pivots.matrix(cell)
                if not own:
                    continue
                y = np.array([v for _, v in own], np.float64).reshape(len(own), cell["dim"])
                names, comps = np.array([i for i, _ in own]), np.array(cell["comp"])
                others, cores = (np.array([drawn[i][c] for i in names.tolist()]) for c in ("comp", "core"))
                rows, columns = np.nonzero(comps[:, None] != others[None, :])
                d = np.sqrt(np.round(blocks.exact(x, y, rows, columns), 12))
                w = np.maximum(np.maximum(d, LEAST), np.maximum(np.array(cell["core"])[rows], cores[columns]))
                yield from _least(rows, columns, w, (np.array(cell["ids"]), comps), (names, others)).to_batches()

    one = dressed.mapInArrow(run, _CANDIDATE)
    return one.union(one.select("cb", "ca", "w", "b", "a"))


def _searched(cells: pivots.Cells, state: DataFrame, best: DataFrame, largest: int) -> DataFrame:
    """Candidates of the components without a proven edge (but for the largest), their least edges among them.

    ``best`` has ``ca, w, proven`` of the components that have an edge from a list.
    """
    dressed = materialise(_dressed(cells, state), "dressed")
    far = materialise(_to_pivots(dressed, cells, state), "far")
    goal = far.select("ca", "w").union(best.select("ca", "w")).groupBy("ca").agg(F.min("w").alias("goal"))
    goal = goal.where(F.col("ca") != largest).join(best.where("proven").select("ca"), "ca", "left_anti")
    held = dressed.select("cell", F.explode(F.array_distinct("comp")).alias("ca")).join(goal, "ca").groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("ca", "goal"))).alias("goals"))
    cut = F.transform(F.arrays_zip("comp", "radius"), lambda s: F.when(s["radius"] < F.col("goals")[s["comp"]], F.col("goals")[s["comp"]]).otherwise(F.lit(-1.0)))
    asking = dressed.join(held, "cell").withColumn("cut", F.transform(cut, lambda x: F.coalesce(x, F.lit(-1.0)))).withColumn("reach", F.array_max("cut")).where("reach >= 0").drop("goals")
    asking = materialise(asking, "asking")
    only = dressed.select("cell", F.when(F.array_min("comp") == F.array_max("comp"), F.array_min("comp")).alias("only"))
    needs = pivots.needed(asking, cells.table, own=True)
    needs = needs.join(only.toDF("a", "oa"), "a").join(only.toDF("b", "ob"), "b").where("oa IS NULL OR ob IS NULL OR oa <> ob").select("a", "pa", "b", "pb")

    def f(cell: dict, others: list[dict]) -> pa.Table | None:
        cut = np.array(cell["cut"])
        asked = np.flatnonzero(cut >= 0)
        x, ids, comps, core, cut = pivots.matrix(cell)[asked], np.array(cell["ids"])[asked], np.array(cell["comp"])[asked], np.array(cell["core"])[asked], cut[asked]
        y = np.concatenate([pivots.matrix(o) for o in others])
        names, theirs, cores = (np.concatenate([o[c] for o in others]) for c in ("ids", "comp", "core"))
        out = []
        for lo in range(0, len(x), blocks.ROWS):
            at = slice(lo, lo + blocks.ROWS)
            d, slack = blocks.squared(x[at], y)
            w = np.maximum(d, np.maximum(core[at, None], cores[None, :]) ** 2)
            w[comps[at, None] == theirs[None, :]] = np.inf
            top = np.minimum(w.min(1), cut[at] ** 2)
            rows, columns = np.nonzero(w <= (top * (1 + 1e-9) + 2 * slack + 2e-12)[:, None])
            e = np.sqrt(np.round(blocks.exact(x[at], y, rows, columns), 12))
            e = np.maximum(np.maximum(e, LEAST), np.maximum(core[at][rows], cores[columns]))
            out.append(_least(rows, columns, e, (ids[at], comps[at]), (names, theirs)))
        return pa.concat_tables(out) if out else None

    found = pivots.met(asking, dressed, needs, f, _CANDIDATE, _CANDIDATES.empty_table())
    return far.union(found)


def forest(cells: pivots.Cells, samples: int) -> tuple[DataFrame, DataFrame]:
    """Edges ``(a, b, w)`` of a minimum spanning forest (of equal ones perhaps more than needed), and ``(id, comp)``."""
    points, listed = reachability(cells, samples)
    both = listed.union(listed.select("b", "a", "w"))
    state = points.withColumn("comp", F.col("id"))
    tree = None
    while True:
        state = materialise(state, "state")
        of = lambda c: state.select(F.col("id").alias(c), F.col("comp").alias(f"c{c}"))  # noqa: B023, E731
        out = both.join(of("a"), "a").join(of("b"), "b").where("ca <> cb").select("ca", "cb", "w", "a", "b")
        edge = F.struct("w", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "cb").alias("e")
        bound = state.groupBy("comp").agg(F.min("radius").alias("bound"), F.count(F.lit(1)).alias("n")).withColumnRenamed("comp", "ca")
        best = bound.join(out.groupBy("ca").agg(F.min(edge).alias("e")), "ca", "left").select("ca", F.col("e.w").alias("w"), (F.col("e.w") <= F.col("bound")).alias("proven"), "e", "n")
        best = materialise(best.withColumn("proven", F.coalesce("proven", F.lit(False))), "best")
        every, sure, most = best.agg(F.count(F.lit(1)), F.count_if("proven"), F.max(F.struct("n", "ca"))).first()
        if every <= 1:
            break
        chosen = best.where("proven").select("ca", "e")
        if 4 * sure < every:
            # the largest one, with most of the points, can wait: an edge that joins it is also the other component's
            found = _searched(cells, state, best.where("w IS NOT NULL"), most.ca).union(out)
            unsure = best.where(~F.col("proven") & (F.col("ca") != most.ca)).select("ca")
            chosen = chosen.union(found.join(unsure, "ca").groupBy("ca").agg(F.min(edge).alias("e")))
        chosen = materialise(chosen.select("ca", "e.cb", "e.w", F.col("e.lo").alias("a"), F.col("e.hi").alias("b")), "chosen")
        if chosen.isEmpty():
            break  # vectors of other lengths are no neighbours
        new = chosen.select("a", "b", "w").distinct()
        tree = new if tree is None else tree.union(new)
        merged = components(chosen, "ca", "cb", 2 * LOCAL).withColumnsRenamed({"node": "comp", "component": "to"})
        state = state.join(merged, "comp", "left").select("id", "core", "radius", F.coalesce("to", "comp").alias("comp"))
    tree = tree if tree is not None else listed.limit(0).select("a", "b", "w")
    return tree.distinct(), state.select("id", "comp")


_SOLVED = "kind string, x string, y string, level double"


def solve(problem: str, u: list[str], v: list[str], w: list[float], size: dict[str, int], least: int) -> list[tuple[str, str, str, float]]:
    """The events of a problem small enough for one task, from its lightest edges on.

    ``attach`` (node, cluster, level), ``cluster`` (cluster, -, level where it begins),
    ``parent`` (cluster, parent, level where they meet), ``export`` (problem, cluster).
    A big node stands for the cluster that its own problem exports.
    """
    out, root = [], {n: n for n in size}
    kind = {n: (s, n if s >= least else None, [n] if s < least else []) for n, s in size.items()}

    def find(n: str) -> str:
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    order = sorted(range(len(w)), key=lambda i: w[i])
    i, made = 0, 0
    while i < len(order):
        level, met = w[order[i]], {}
        while i < len(order) and w[order[i]] == level:
            e = order[i]
            i += 1
            a, b = find(u[e]), find(v[e])
            if a != b:
                root[a] = b
                met[b] = met.pop(a, [a]) + met.pop(b, [b])
        for top, parts in met.items():
            total = sum(kind[p][0] for p in parts)
            clusters = [kind[p][1] for p in parts if kind[p][1] is not None]
            loose = [n for p in parts for n in kind[p][2]]
            mine = clusters[0] if len(clusters) == 1 else None
            if len(clusters) > 1 or not clusters and total >= least:
                mine = f"{problem}#{made}"
                made += 1
                out.append(("cluster", mine, "", level))
                out += [("parent", c, mine, level) for c in clusters]
            if mine is not None:
                out += [("attach", n, mine, level) for n in loose]
                loose = []
            kind[top] = (total, mine, loose)
    ends = {find(n) for n in size}
    return out + [("export", problem, kind[e][1], 0.0) for e in ends if kind[e][1] is not None]


def _local(edges: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    def run(key: tuple, e: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        got = solve(key[0], e["u"].tolist(), e["v"].tolist(), e["w"].tolist(), dict(zip(n["u"], n["size"], strict=True)), least)
        return pd.DataFrame(got, columns=["kind", "x", "y", "level"])

    nodes = nodes.toDF(*nodes.columns)
    return edges.groupBy("p").cogroup(nodes.groupBy("p")).applyInPandas(run, _SOLVED)


def _flat(edges: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """The events of problems whose edges all weigh the same: everything meets at once."""
    about = nodes.groupBy("p").agg(F.sum("size").alias("total"), F.count_if(F.col("size") >= least).alias("big"), F.max(F.when(F.col("size") >= least, F.col("u"))).alias("one"))
    level = edges.groupBy("p").agg(F.min("w").alias("level"))
    x = level.join(about, "p").withColumn("new", (F.col("big") > 1) | (F.col("big") == 0) & (F.col("total") >= least))
    x = x.withColumn("mine", F.when(F.col("new"), F.concat("p", F.lit("#0"))).otherwise(F.col("one"))).where("mine IS NOT NULL")
    each = nodes.join(x.select("p", "level", "new", "mine"), "p")
    row = lambda df, kind, a, b, level: df.select(F.lit(kind).alias("kind"), a.alias("x"), b.alias("y"), level.alias("level"))
    c = F.col
    out = row(each.where(c("size") < least), "attach", c("u"), c("mine"), c("level"))
    out = out.union(row(each.where(c("new") & (c("size") >= least)), "parent", c("u"), c("mine"), c("level")))
    out = out.union(row(x.where("new"), "cluster", c("mine"), F.lit(""), c("level")))
    return out.union(row(x, "export", c("p"), c("mine"), F.lit(0.0)))


def hierarchy(tree: DataFrame, comps: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The condensed tree: ``(id, cluster, level)`` of the points in some cluster, and ``(cluster, bottom, parent, top)``.

    A point leaves its cluster at ``level`` at the latest; a cluster begins at
    ``bottom`` and meets others at ``top`` (null for a root).
    """
    named = lambda c: F.concat(F.lit("x"), F.col(c).cast("string"))
    edges = tree.join(comps, tree["a"] == comps["id"]).select(F.concat(F.lit("r"), F.col("comp").cast("string")).alias("p"), named("a").alias("u"), named("b").alias("v"), "w")
    nodes = comps.select(F.concat(F.lit("r"), F.col("comp").cast("string")).alias("p"), named("id").alias("u"), F.lit(1).cast("long").alias("size"))
    edges, nodes = materialise(edges, "edges"), materialise(nodes, "nodes")
    events, within, turn = [], [], 0
    while True:
        about = edges.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("lo"), F.max("w").alias("hi"), F.percentile_approx("w", 0.5, 1000).alias("t"))
        about = materialise(about.withColumn("how", F.when(F.col("n") <= LOCAL, "local").when(F.col("lo") == F.col("hi"), "flat").otherwise("split")), "about")
        pick = lambda df, how: df.join(about.where(F.col("how") == how).select("p"), "p")  # noqa: B023, E731
        hows = {r.how for r in about.select("how").distinct().collect()}
        if "local" in hows:
            events.append(materialise(_local(pick(edges, "local"), pick(nodes, "local"), least), "events"))
        if "flat" in hows:
            events.append(materialise(_flat(pick(edges, "flat"), pick(nodes, "flat"), least), "events"))
        if "split" not in hows:
            break
        # the median, or what is next below it where half of the edges weigh the most
        open_ = edges.join(about.where("how = 'split'").select("p", "t", "hi"), "p")
        below = open_.where("w < hi").groupBy("p").agg(F.max("w").alias("below"))
        open_ = materialise(open_.join(below, "p").select("p", "u", "v", "w", F.least("t", "below").alias("t")), "open")
        part = components(open_.where("w <= t"), "u", "v", 2 * LOCAL).select(F.col("node").alias("u"), F.concat(F.lit(f"k{turn}|"), "component").alias("k"))
        placed = materialise(pick(nodes, "split").join(part, "u", "left"), "placed")
        sums = placed.where("k IS NOT NULL").groupBy("p", "k").agg(F.sum("size").alias("size"))
        big = sums.where(F.col("size") >= least).select("k")
        within.append(placed.where("k IS NOT NULL").join(big, "k", "left_anti").select("u", "k"))
        at = placed.select("u", "k")
        low = open_.where("w <= t").join(at, "u").join(big, "k").select(F.col("k").alias("p"), "u", "v", "w")
        ends = open_.where("w > t").join(at, "u").withColumnRenamed("k", "ku").join(at.toDF("v", "kv"), "v")
        high = ends.select("p", F.coalesce("ku", "u").alias("u"), F.coalesce("kv", "v").alias("v"), "w").where("u <> v")
        inner = placed.join(big, "k").select(F.col("k").alias("p"), "u", "size")
        outer = placed.where("k IS NULL").select("p", "u", "size").union(sums.select("p", F.col("k").alias("u"), "size"))
        edges, nodes = materialise(low.union(high), "edges"), materialise(inner.union(outer), "nodes")
        turn += 1
    if not events:
        events = [tree.sparkSession.createDataFrame([], _SOLVED)]
    every = events[0]
    for e in events[1:]:
        every = every.union(e)
    every = materialise(every, "events")
    names = every.where("kind = 'export'").select(F.col("x").alias("name"), F.col("y").alias("means"))
    resolved = every.where("kind <> 'export'")
    for _ in range(turn + 1):  # a problem may export what a problem within it exports, and so on
        for c in ("x", "y"):
            if c == "x":
                hit = names.withColumnRenamed("means", "to")
                resolved = resolved.join(hit, (F.col("x") == F.col("name")) & (F.col("kind") == "parent"), "left").select("kind", F.coalesce("to", "x").alias("x"), "y", "level")
            else:
                resolved = resolved.join(names, F.col("y") == F.col("name"), "left").select("kind", "x", F.coalesce("means", "y").alias("y"), "level")
    resolved = materialise(resolved, "resolved")
    points = resolved.where("kind = 'attach'").select(F.col("x").alias("u"), F.col("y").alias("cluster"), "level")
    for w in reversed(within):
        inside = points.join(w, points["u"] == w["k"]).select(w["u"], "cluster", "level")
        points = points.join(w.select(F.col("k").alias("u")).distinct(), "u", "left_anti").union(inside)
    points = materialise(points.select(F.substring("u", 2, 30).cast("long").alias("id"), "cluster", "level"), "attached")
    clusters = resolved.where("kind = 'cluster'").select(F.col("x").alias("cluster"), F.col("level").alias("bottom"))
    parents = resolved.where("kind = 'parent'").select(F.col("x").alias("cluster"), F.col("y").alias("parent"), F.col("level").alias("top"))
    return points, materialise(clusters.join(parents, "cluster", "left"), "clusters")


_STEP = "cluster string, parent string, size long, stability double, chosen boolean, worth double"


def _climbed(g: pd.DataFrame) -> pd.DataFrame:
    """The same step for all clusters that are left, if they are few: from those without open descendants up."""
    left = {r.cluster: r for r in g.itertuples(index=False)}
    got = {c: [r.ready, r.below, r.value] for c, r in left.items()}
    todo, out = [c for c, r in left.items() if r.ready == r.kids], []
    while todo:
        c = todo.pop()
        r, (_, below, value) = left[c], got[c]
        rate = r.from_
        stability = r.s - r.n * rate + below * (r.at - rate)
        better = r.kids == 0 or stability >= value
        size, worth = r.n + below, stability if better else value
        out.append((c, r.parent, size, stability, better and r.parent is not None, worth))
        if r.parent is not None:
            up = got[r.parent]
            up[0], up[1], up[2] = up[0] + 1, up[1] + size, up[2] + worth
            if up[0] == left[r.parent].kids:
                todo.append(r.parent)
    return pd.DataFrame(out, columns=["cluster", "parent", "size", "stability", "chosen", "worth"])


def stable(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(cluster, chosen, stability, size)``, from the leaves up."""
    rate = lambda c: F.coalesce(1 / F.col(c), F.lit(0.0))
    own = points.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(1 / F.col("level")).alias("s"))
    kids = clusters.groupBy(F.col("parent").alias("cluster")).agg(F.count(F.lit(1)).alias("kids"))
    x = clusters.join(own, "cluster", "left").join(kids, "cluster", "left").fillna(0, ["n", "s", "kids"])
    x = x.select("cluster", "parent", "n", "s", "kids", rate("bottom").alias("at"), rate("top").alias("from"))
    waiting, done = materialise(x, "waiting"), None
    known = waiting.limit(0).select("parent", F.lit(0).cast("long").alias("ready"), F.lit(0).cast("long").alias("below"), F.lit(0.0).alias("value"))
    while not waiting.isEmpty():
        sums = known.groupBy(F.col("parent").alias("cluster")).agg(F.sum("ready").alias("ready"), F.sum("below").alias("below"), F.sum("value").alias("value"))
        now = waiting.join(sums, "cluster", "left").fillna(0, ["ready", "below", "value"])
        if waiting.count() <= LOCAL:
            step = materialise(now.withColumnRenamed("from", "from_").groupBy(F.lit(0).alias("all")).applyInPandas(_climbed, _STEP), "step")
            done = step if done is None else done.union(step)
            break
        ripe = now.where("ready = kids")
        stability = F.col("s") - F.col("n") * F.col("from") + F.col("below") * (F.col("at") - F.col("from"))
        better = (F.col("kids") == 0) | (stability >= F.col("value"))
        step = ripe.select("cluster", "parent", (F.col("n") + F.col("below")).alias("size"), stability.alias("stability"), (better & F.col("parent").isNotNull()).alias("chosen"), F.when(better, stability).otherwise(F.col("value")).alias("worth"))
        step = materialise(step, "step")
        done = step if done is None else done.union(step)
        known = materialise(now.where("ready < kids").select(F.col("cluster").alias("parent"), "ready", "below", "value").union(step.where("parent IS NOT NULL").select("parent", F.lit(1).cast("long"), "size", "worth")), "known")
        waiting = materialise(waiting.join(step.select("cluster"), "cluster", "left_anti"), "waiting")
    if done is None:
        done = clusters.select("cluster", "parent", F.lit(0).cast("long").alias("size"), F.lit(0.0).alias("stability"), F.lit(False).alias("chosen"), F.lit(0.0).alias("worth"))
    return done


def cluster(points: DataFrame, size: int, samples: int, key: str = "id", vector: str = "v") -> DataFrame:
    """``(id, label)``: the least id of a point's cluster, or -1 for noise; clusters have ``size`` points at least."""
    if size < 2:
        raise ValueError("clusters have two points at least")
    cells = pivots.build(points, key, vector)
    tree, comps = forest(cells, samples)
    attached, clusters = hierarchy(tree, comps, size)
    chosen = stable(attached, clusters)
    # the topmost chosen cluster above each, in steps that double
    up = materialise(chosen.select("cluster", F.col("parent").alias("up"), F.when(F.col("chosen"), F.col("cluster")).alias("best")), "up")
    while not up.where("up IS NOT NULL").isEmpty():
        further = up.select(F.col("cluster").alias("up"), F.col("up").alias("next"), F.col("best").alias("higher"))
        up = materialise(up.join(further, "up", "left").select("cluster", F.col("next").alias("up"), F.coalesce("higher", "best").alias("best")), "up")
    found = attached.join(up.select("cluster", "best"), "cluster").where("best IS NOT NULL").select("id", "best")
    names = found.groupBy("best").agg(F.min("id").alias("label"))
    return comps.select("id").join(found.join(names, "best").select("id", "label"), "id", "left").select("id", F.coalesce("label", F.lit(-1).cast("long")).alias("label"))

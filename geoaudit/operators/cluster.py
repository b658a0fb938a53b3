"""Clusterings: signatures, agreement, internal quality, matching across regions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoaudit.functions.features import quotient
from geoaudit.operators import blocks, pivots
from geoaudit.operators.components import components

#: Counts in a run of the expected mutual information.
RUN = 4096


def signatures(df: DataFrame, cluster: str, values: list[str], k: int) -> DataFrame:
    """Size, share, means and population deviations of clusters 0 to k - 1; empty ones have size 0."""
    stats = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), *(f(v).alias(f"{v}_{n}") for v in values for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))))
    every = df.sparkSession.range(k).select(F.col("id").alias(cluster))
    out = every.join(stats, cluster, "left").fillna(0, ["size"])
    return out.withColumn("share", F.col("size") / F.sum("size").over(Window.partitionBy()))  # k rows


def z_signatures(df: DataFrame, cluster: str, values: list[str], by: list[str] | None = None) -> DataFrame:
    """Cluster means as z-scores of the whole table's moments, or of those of each group ``by``."""
    by = by or []
    moments = [f(v).alias(f"__{v}{n}") for v in values for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))]
    means = df.groupBy(*by, cluster).agg(*(F.avg(v).alias(v) for v in values))
    whole = F.broadcast(df.groupBy(*by).agg(*moments) if by else df.agg(*moments))
    both = means.join(whole, by) if by else means.crossJoin(whole)
    return both.select(*by, cluster, *(((F.col(v) - F.col(f"__{v}m")) / (F.col(f"__{v}s") + 1e-9)).alias(v) for v in values))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts ``(a, b, n)`` of two labellings."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def row_normalised(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency with each row's share (its total plus 1e-9)."""
    t = contingency(df, a, b)
    return t.withColumn("share", F.col("n") / (F.sum("n").over(Window.partitionBy("a")) + 1e-9))


def log_factorial(k: Column) -> Column:
    """ln k! of a whole number: listed below 16, from there on by Stirling's series (error below 1e-11)."""
    k = k.cast("double")
    listed = F.array(*(F.lit(math.lgamma(i + 1)) for i in range(16)))
    series = (k + 0.5) * F.log(k) - k + 0.5 * math.log(2 * math.pi) + 1 / (12 * k) - 1 / (360 * k * k * k) + 1 / (1260 * F.pow(k, 5))
    return F.when(k < 16, F.get(listed, F.greatest(k, F.lit(0.0)).cast("int"))).otherwise(series)


def _adjusted(pairs: Column, trivial: float) -> Column:
    """Adjusted Rand index from the pairs that agree in both (``pab``), in one (``pa``) and in the other (``pb``), of all ``pairs``."""
    expected, most = F.try_divide(F.col("pa") * F.col("pb"), pairs), (F.col("pa") + F.col("pb")) / 2
    return F.when((pairs == 0) | (most == expected), F.lit(trivial)).otherwise(F.try_divide(F.col("pab") - expected, most - expected))


def agreement(df: DataFrame, a: str, b: str, trivial: float = 1.0) -> DataFrame:
    """One row: adjusted Rand index ``ari`` and normalised mutual information ``nmi`` (arithmetic mean).

    ``trivial`` stands for 0 / 0: no pair of rows could be told apart by chance, or both
    labellings have one class.
    """
    t = contingency(df, a, b)
    w = lambda k: Window.partitionBy(k)  # noqa: E731  - the table of two labellings, not the rows
    pairs = lambda x: x * (x - 1) / 2.0
    rows = t.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("pa"), F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias("la"), F.count(F.lit(1)).alias("ka"))
    cols = t.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("pb"), F.sum(F.col("n") * F.log("n")).alias("lb"), F.count(F.lit(1)).alias("kb"))
    both = t.agg(F.sum(pairs(F.col("n"))).alias("pab"), F.sum(F.col("n") * F.log("n")).alias("lab"))
    x = rows.crossJoin(cols).crossJoin(both)
    n = F.col("n")
    ari = _adjusted(pairs(n), trivial)
    ha, hb = F.log(n) - F.col("la") / n, F.log(n) - F.col("lb") / n
    mi = F.log(n) + (F.col("lab") - F.col("la") - F.col("lb")) / n
    nmi = F.when((F.col("ka") == 1) & (F.col("kb") == 1), F.lit(trivial)).otherwise(quotient(F.greatest(mi, F.lit(0.0)), (ha + hb) / 2))
    return x.select(n.alias("n"), ari.alias("ari"), nmi.alias("nmi"))


def expected_information(df: DataFrame, a: str, b: str, trivial: float = 1.0) -> DataFrame:
    """One row ``(emi, ami)``: expected and adjusted mutual information under fixed margins; ``trivial`` is the latter of two labellings with one class each.

    Sums over pairs of classes and the counts where the hypergeometric law has its
    mass (twelve deviations around its mean); the counts of a pair are made in runs,
    so that no array is longer than the larger of a run and their number.
    """
    t = contingency(df, a, b)
    n = t.agg(F.sum("n")).first()[0] or 0
    x, y, m = F.col("x"), F.col("y"), F.col("m")
    ma, mb = t.groupBy("a").agg(F.sum("n").alias("x")), t.groupBy("b").agg(F.sum("n").alias("y"))
    mean = x * y / F.lit(float(n or 1))
    wide = 12 * F.sqrt(mean * (1 - x / float(n or 1)) * (1 - y / float(n or 1))) + 12
    low = F.greatest(F.lit(1).cast("bigint"), x + y - n, F.floor(mean - wide))
    high = F.least(x, y, F.ceil(mean + wide))
    pairs = ma.crossJoin(mb).withColumn("low", low).withColumn("high", high).where("low <= high")  # pairs of clusters, not of rows
    runs = pairs.withColumn("first", F.explode(F.sequence("low", "high", F.lit(RUN).cast("bigint"))))
    terms = runs.withColumn("m", F.explode(F.sequence("first", F.least(F.col("first") + RUN - 1, F.col("high")))))
    lf, whole = log_factorial, F.lit(n)
    p = F.exp(lf(x) + lf(y) + lf(whole - x) + lf(whole - y) - lf(whole) - lf(m) - lf(x - m) - lf(y - m) - lf(whole - x - y + m))
    emi = terms.agg(F.sum(m / n * F.log(m.cast("double") * n / (x * y)) * p).alias("emi"))
    w = t.groupBy("a").agg(F.sum("n").alias("n")).agg((F.log(F.lit(float(n or 1))) - F.sum(F.col("n") * F.log("n")) / n).alias("ha"), F.count(F.lit(1)).alias("ka"))
    v = t.groupBy("b").agg(F.sum("n").alias("n")).agg((F.log(F.lit(float(n or 1))) - F.sum(F.col("n") * F.log("n")) / n).alias("hb"), F.count(F.lit(1)).alias("kb"))
    c = t.agg((F.log(F.lit(float(n or 1))) - F.sum(F.col("n") * F.log("n")) / n).alias("hab"))
    x = emi.crossJoin(w).crossJoin(v).crossJoin(c)
    mi = F.col("ha") + F.col("hb") - F.col("hab")
    ami = quotient(mi - F.col("emi"), (F.col("ha") + F.col("hb")) / 2 - F.col("emi"))
    return x.select("emi", F.when((F.col("ka") == 1) & (F.col("kb") == 1), F.lit(trivial)).otherwise(ami).alias("ami"))


def pairwise_agreement(labels: DataFrame, keys: list[str], run: str, label: str, trivial: float = 1.0) -> DataFrame:
    """``(i, j, ari)``: adjusted Rand index of every two runs over the rows that both label, ``trivial`` for 0 / 0.

    A row's labels come together once (one per run), and pairs of runs are counted
    into tables of labels before anything else is exchanged.
    """
    listed = labels.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(run).alias("run"), F.col(label).alias("label")))).alias("x"))
    two = F.flatten(F.transform("x", lambda p: F.transform(F.filter("x", lambda q: q["run"] > p["run"]), lambda q: F.struct(p["run"].alias("i"), q["run"].alias("j"), p["label"].alias("a"), q["label"].alias("b")))))
    t = listed.select(F.explode(two).alias("p")).groupBy("p.i", "p.j", "p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda: F.sum(F.col("n") * (F.col("n") - 1) / 2.0)
    side = lambda c: t.groupBy("i", "j", c).agg(F.sum("n").alias("n")).groupBy("i", "j").agg(pairs().alias(f"p{c}"))
    x = t.groupBy("i", "j").agg(pairs().alias("pab"), F.sum("n").alias("n")).join(side("a"), ["i", "j"]).join(side("b"), ["i", "j"])
    return x.select("i", "j", _adjusted(F.col("n") * (F.col("n") - 1) / 2.0, trivial).alias("ari"))


def internal_quality(df: DataFrame, cluster: str, values: list[str], single: float = math.nan) -> DataFrame:
    """One row ``(davies_bouldin, calinski_harabasz)`` from the clusters' centroids.

    A single cluster has no Davies-Bouldin index (null), and ``single`` for the other,
    or NaN if it has no spread; equal centroids are infinitely alike.
    """
    cent = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *(F.avg(v).alias(f"__{v}") for v in values))
    cent = cent.withColumn("__m", F.array(*(F.col(f"__{v}") for v in values)))
    dist2 = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    x = df.join(F.broadcast(cent.select(cluster, "__m")), cluster).withColumn("__d", dist2(F.array(*values), F.col("__m")))  # one row per cluster
    within = x.groupBy(cluster).agg(F.avg(F.sqrt("__d")).alias("s"), F.sum("__d").alias("ss"))
    c = cent.join(within, cluster)
    whole = F.array(*((F.sum(F.col(f"__{v}") * F.col("n")).over(Window.partitionBy()) / F.sum("n").over(Window.partitionBy())) for v in values))
    ch = c.withColumn("__g", dist2(F.col("__m"), whole)).agg(F.sum(F.col("n") * F.col("__g")).alias("b"), F.sum("ss").alias("w"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    between = F.when(F.col("k") == 1, F.when(F.col("w") > 0, F.lit(single)).otherwise(F.lit(math.nan))).otherwise(quotient(F.col("b"), F.col("k") - 1))
    ch = ch.select(quotient(between, quotient(F.col("w"), F.col("n") - F.col("k"))).alias("calinski_harabasz"))
    l, r = c.select(F.col(cluster).alias("i"), F.col("s").alias("si"), F.col("__m").alias("mi")), c.select(F.col(cluster).alias("j"), F.col("s").alias("sj"), F.col("__m").alias("mj"))
    worst = l.crossJoin(r).where("i <> j").groupBy("i").agg(F.max(quotient(F.col("si") + F.col("sj"), F.sqrt(dist2(F.col("mi"), F.col("mj"))))).alias("w"))
    return worst.agg(F.avg("w").alias("davies_bouldin")).crossJoin(ch)


def silhouette(points: DataFrame, key: str, cluster: str, vector: str) -> DataFrame:
    """One row ``(n, silhouette)``: exact Euclidean silhouette over all points.

    Every block of points meets every block; a point's distances are summed by
    cluster within a pair of blocks, so a pair gives one row per point and
    cluster.  The comparisons grow with the square of the rows.  The only point of
    a cluster counts 0; ids are unique.
    """

    def run(g: pa.Table) -> pa.Table:
        l, x, r, y = blocks.sides(g)
        kinds = g.column("label").combine_chunks().unique()
        mine, theirs = (pc.index_in(t.column("label"), kinds).to_numpy(zero_copy_only=False) for t in (l, r))
        member = (theirs[:, None] == np.arange(len(kinds))[None, :]).astype(np.float64)
        total = np.zeros((len(x), len(kinds)))
        for lo in range(0, len(x) if len(y) else 0, blocks.ROWS):
            part = x[lo : lo + blocks.ROWS]
            d, slack = blocks.squared(part, y)
            a, b = np.nonzero(d <= 1e4 * slack[:, None])  # copies and the like: by differences
            d[a, b] = blocks.exact(part, y, a, b)
            total[lo : lo + blocks.ROWS] = np.sqrt(d, out=d) @ member
        m = np.tile(member.sum(0).astype(np.int64), (len(x), 1))
        if g.column("i")[0] == g.column("j")[0]:
            m[np.arange(len(x)), mine] -= 1  # the point itself, at distance 0
        a, c = np.nonzero(m)
        return pa.table({"i": l.column("id").take(pa.array(a)), "ci": l.column("label").take(pa.array(a)), "cj": kinds.take(pa.array(c)), "d": total[a, c], "m": m[a, c]})

    kept = points.select(F.col(key).alias("i"), F.col(cluster).alias("c")).schema
    shape = T.StructType([kept["i"], T.StructField("ci", kept["c"].dataType), T.StructField("cj", kept["c"].dataType), T.StructField("d", T.DoubleType()), T.StructField("m", T.LongType())])
    points = points.where(F.col(cluster).isNotNull())
    sums = blocks.paired(points, points, key, vector, cluster).groupBy("i", "j", "dim").applyInArrow(run, shape)
    means = sums.groupBy("i", "ci", "cj").agg((F.sum("d") / F.sum("m")).alias("d"))
    per = means.groupBy("i", "ci").agg(F.max(F.when(F.col("ci") == F.col("cj"), F.col("d"))).alias("a"), F.min(F.when(F.col("ci") != F.col("cj"), F.col("d"))).alias("b"))
    s = F.when(F.col("a").isNull() | (F.greatest("a", "b") == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.avg(s).alias("silhouette"))


def best_way(score: np.ndarray) -> list[int]:
    """For each row the column of the one-to-one matching with the greatest total, the first in order of equal ones.

    Dynamic programming over sets of used columns: k 2**k steps.
    """
    k = len(score)
    best: dict[int, tuple[float, int]] = {(1 << k) - 1: (0.0, -1)}
    for used in sorted(range((1 << k) - 1), key=int.bit_count, reverse=True):
        i = used.bit_count()
        free = [j for j in range(k) if not used >> j & 1]
        totals = [score[i, j] + best[used | 1 << j][0] for j in free]
        top = max(totals)
        best[used] = next((t, j) for t, j in zip(totals, free, strict=True) if t >= top - 5e-10)
    way, used = [], 0
    while len(way) < k:
        way.append(best[used][1])
        used |= 1 << way[-1]
    return way


def matched(pairs: DataFrame, a: str, b: str, score: str, k: int, by: list[str]) -> DataFrame:
    """The one-to-one matching of k and k clusters with the greatest total score, per group.

    ``pairs`` has k times k rows a group (k up to 16); ties go to the first in order.
    A group that lacks one of the clusters has no such matching, and no rows.
    """
    if k > 16:
        raise ValueError("matching takes up to 16 clusters")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        if len(g) < k * k:
            return g.iloc[:0]
        g = g.sort_values([a, b])
        way = best_way(g[score].to_numpy(float).reshape(k, k))
        return g.iloc[[i * k + j for i, j in enumerate(way)]]

    kept = pairs.select(*by, a, b, score)
    return kept.groupBy(*by).applyInPandas(run, kept.schema)


def linked_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node: the least node reachable by ``edges``."""
    found = components(edges).withColumnRenamed("node", "n")
    return nodes.join(found, F.col("node") == F.col("n"), "left").select("node", F.coalesce("component", "node").alias("component"))


def nearest_label(points: DataFrame, known: DataFrame, k: int, key: str, vector: str, label: str) -> DataFrame:
    """Label of each point by majority of its k nearest known vectors (ties: the least label).

    Neighbours come from cells bounded by pivots; a known vector with the point's own
    id is not asked.  Distances are compared at 12 decimals, ties by id; ids are
    integers.
    """
    labels = known.where(F.col(label).isNotNull()).select(F.col(key).alias("j"), F.col(label).alias("lj"))
    if points is known:
        both = points.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.lit(True).alias("asked"), F.col(label).isNotNull().alias("known"))
    else:
        side = lambda df, asked: df.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.lit(asked).alias("asked"), F.lit(not asked).alias("known"))
        both = side(points, True).union(side(known.where(F.col(label).isNotNull()), False))
    near = pivots.knn(pivots.build(both, asked="asked", known="known"), k).join(labels, "j")
    votes = near.groupBy("i", "lj").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("i").agg(F.max(F.struct("n", (-F.col("lj")).alias("l"))).alias("m")).select(F.col("i").alias(key), (-F.col("m.l")).alias(label))


def morphotype(mrvbf: Column, mrrtf: Column, twi: Column, slope: Column) -> Column:
    """Name of a landform signature by fixed rules on its mean z-scores."""
    return (
        F.when((mrvbf > 0.5) & (twi > 0.3), "valley_bottom").when(mrrtf > 0.5, "ridgetop_flat").when(slope > 0.4, "steep_slope")
        .when(slope < -0.3, "lowland_flat").otherwise("mid_slope")
    )

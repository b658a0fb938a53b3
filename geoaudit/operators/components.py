"""Connected components of a link table by alternating star contractions.

Links become edges towards smaller ids.  A large-star step hangs the greater
neighbours of every node on the least node around it, a small-star step does
the same with the smaller ones; after a few rounds every component is a star
around its least id.  Each round is one aggregate (combined before the shuffle)
and one plain join per step, so a node with very many neighbours is split by
the optimiser's skew join and never gathered; each round is written to the
shared folder, and nothing but two numbers reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoaudit.session import dematerialise, materialise

#: Rounds needed grow with the logarithm of the longest path; this is far beyond.
MOST_ROUNDS = 60


def _hang(edges: DataFrame, towards: DataFrame) -> DataFrame:
    """(v, least node around u) for every edge (u, v), where ``towards`` has the least one by u."""
    return edges.join(towards, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def _at_once(edges: DataFrame) -> DataFrame:
    """The stars of few edges, by one task."""
    node = edges.schema["a"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root: dict = {}

        def find(x):
            root.setdefault(x, x)
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for g in parts:
            for x, y in zip(g["a"], g["b"], strict=True):
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
        found = [(x, find(x)) for x in list(root)]
        yield pd.DataFrame([f for f in found if f[0] != f[1]], columns=["a", "b"])

    return edges.coalesce(1).mapInPandas(run, f"a {node}, b {node}")


def components(links: DataFrame, a: str = "a", b: str = "b", few: int = 0) -> DataFrame:
    """``(node, component)`` for every node of ``links``; component is the least id reachable.

    As soon as no more than ``few`` edges are left, one task finishes them.

    Links with a null end are void, loops make a component of one, repeated
    links count once; an empty table gives an empty result.
    """
    links = links.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna()
    edges = materialise(links.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).where("a <> b").distinct(), "edges")
    loops = links.where("x = y").select(F.col("x").alias("node"), F.col("x").alias("component")).distinct()
    before = _state(edges)
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        if before[0] <= few:
            edges = materialise(_at_once(edges), "edges")
            break
        both = edges.selectExpr("a AS u", "b AS v").union(edges.selectExpr("b AS u", "a AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _hang(both.where("v > u"), least).distinct()
        # small star: of the edges (a, b) with a > b, all of a's smaller ends and a itself go to the least of them
        mins = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(mins, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = materialise(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        now = _state(after)
        dematerialise(edges)
        edges = after
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no components after {MOST_ROUNDS} rounds")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.union(roots).union(loops).groupBy("node").agg(F.min("component").alias("component"))


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number of edges and an order-free checksum."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit(0xFFFFFFFF)))).first()
    return row[0], row[1] or 0

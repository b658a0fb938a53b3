"""Hard-negative mining by distributed radix selection.

For every window (an anchor, which rows count, a range of scores) the first k rows
are wanted, higher scores first, ties by smaller id.  No task ever sorts what a
window holds.  A pass has the tiles of rows and anchors count integer histograms of
the scores of every window, ``DIGIT`` buckets over the range in which its k-th row
must lie; the counts of all tiles are added, and the bucket that holds the k-th row
is the next range.  Where one score is left and still has too many rows, the passes
go on by the digits of the ids.  As soon as the rows down to that bucket's end are
few (``GATHER``), the window is settled; a last pass gathers exactly those rows, and
they are ranked.  So however many rows tie at a score, no window brings more than
``GATHER`` rows together.

Anchors are a stated part of the rows, compared with all rows in tiles: rows are
dealt into groups and anchors into blocks by hashes of their ids, and every block
meets every group.  A pass shuffles the rows once per block of anchors and the
anchors once per group of rows; histograms are combined before their shuffle.

Defined results: rows take no part whose id, label or vector is null or whose vector
holds a null or non-finite component; of rows that share an id the one with the
least label, then vector, counts; vectors of different lengths do not meet; quantised
components beyond +-2^22 count as +-2^22 (so that no score overflows); an anchor
without other rows of its label, or whose windows are empty, has no row in the
result; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoaudit.llm._frames import col
from geoaudit.session import materialise, table

#: Buckets of a histogram, and rows that a window may bring together.
DIGIT = 256
GATHER = 64
#: Components of a group's rows or a block's anchors, and anchors multiplied at once.
TILE = 1 << 21
ANCHORS = 32
#: Largest quantised component.
MOST = 1 << 22
_LAST = (1 << 63) - 1


def quantised(df: DataFrame, key: str, vector: str, label: Column, scale: float = 256.0) -> DataFrame:
    """``(id, label, q, dim)`` of the rows that take part; q is ``floor(scale * x)``, in double precision."""
    v = col(vector)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rounded = F.transform(v, lambda x: F.floor(F.least(F.greatest(x.cast("double") * F.lit(scale), F.lit(-float(MOST))), F.lit(float(MOST)))).cast("int"))
    kept = df.where(col(key).isNotNull() & label.isNotNull() & v.isNotNull()).where(~odd)
    rows = materialise(kept.select(col(key).cast("long").alias("id"), label.cast("long").alias("label"), rounded.alias("q"), F.size(v).alias("dim")), "quantised")
    if rows.groupBy("id").count().where("count > 1").isEmpty():
        return rows
    one = rows.groupBy("id").agg(F.min(F.struct("label", "q", "dim")).alias("r")).select("id", "r.*")
    return materialise(one, "quantised")


def _pairs(rows: DataFrame, queries: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], shape: str, groups: int, blocks: int) -> DataFrame:
    """``f`` of every group of rows beside every block of queries."""
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("*", own(groups).alias("g"), every(blocks).alias("b")).groupBy("dim", "g", "b")
    # queries come from rows: fresh columns tell both sides apart
    right = queries.toDF(*queries.columns).select("*", every(groups).alias("g"), own(blocks).alias("b")).groupBy("dim", "g", "b")
    return left.cogroup(right).applyInArrow(f, shape)


def _matrix(t: pa.Table) -> np.ndarray:
    dim = t.column("dim")[0].as_py()
    return t.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(t.num_rows, dim)


def scores(rows: pa.Table, queries: pa.Table) -> Iterator[tuple[dict, np.ndarray]]:
    """Each query's row with the integer inner products of all rows.

    Products are taken in doubles while those hold them exactly, else in integers.
    """
    x, q = _matrix(rows), _matrix(queries)
    largest = lambda m: int(np.abs(m).max()) if m.size else 0
    exact = largest(x) * largest(q) * max(1, x.shape[1]) < 1 << 53
    if exact:
        x, q = x.astype(np.float64), q.astype(np.float64)
    about = queries.drop_columns(["q"]).to_pylist()
    for lo in range(0, len(about), ANCHORS):
        s = (q[lo : lo + ANCHORS] @ x.T).astype(np.int64)
        yield from zip(about[lo : lo + ANCHORS], s, strict=True)


def _counted(rows: pa.Table, queries: pa.Table) -> pa.Table:
    """Histograms of every window over the rows of one group."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    if rows.num_rows and queries.num_rows:
        ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        for anchor, s in scores(rows, queries):
            like = labels == anchor["label"]
            sides = {True: like & (ids != anchor["id"]), False: ~like}
            for w in anchor["windows"]:
                if w["by_id"]:
                    at = ids[sides[w["same"]] & (s == w["low"]) & (ids >= w["first"]) & (ids <= w["last"])]
                    # differences of ids may need 64 bits
                    digit = ((at.astype(np.uint64) - np.uint64(w["first"] % (1 << 64))) // np.uint64(w["width"])).astype(np.int64)
                else:
                    at = s[sides[w["same"]] & (s >= w["low"]) & (s <= w["high"])]
                    digit = (w["high"] - at) // w["width"]
                n = np.bincount(digit, minlength=1)
                full = np.flatnonzero(n)
                for o, v in zip(out, (np.full(len(full), anchor["id"]), np.full(len(full), w["w"]), full, n[full]), strict=True):
                    o.append(v)
    columns = [np.concatenate(o).astype(np.int64) if o else np.zeros(0, np.int64) for o in out]
    return pa.table(dict(zip(("anchor", "w", "digit", "n"), columns, strict=True)))


def _gathered(rows: pa.Table, queries: pa.Table) -> pa.Table:
    """Rows of one group that qualify for each settled window."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    if rows.num_rows and queries.num_rows:
        ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        for anchor, s in scores(rows, queries):
            like = labels == anchor["label"]
            sides = {True: like & (ids != anchor["id"]), False: ~like}
            for w in anchor["windows"]:
                at = np.flatnonzero(sides[w["same"]] & (s <= w["top"]) & ((s > w["low"]) | (s == w["low"]) & (ids <= w["last"])))
                for o, v in zip(out, (np.full(len(at), anchor["id"]), np.full(len(at), w["w"]), ids[at], s[at]), strict=True):
                    o.append(v)
    columns = [np.concatenate(o).astype(np.int64) if o else np.zeros(0, np.int64) for o in out]
    return pa.table(dict(zip(("anchor", "w", "id", "score"), columns, strict=True)))


#: Of a window: range of scores, ids and digits, what is still wanted, and whether it is settled.
_STATE = ["anchor", "w", "same", "k", "top", "low", "high", "by_id", "first", "last", "need", "settled"]


def _width(low: str, high: str) -> Column:
    wide = F.col(high).cast("decimal(20,0)") - F.col(low).cast("decimal(20,0)")
    return (F.floor(wide / DIGIT) + 1).cast("long")


def _narrowed(states: DataFrame, counts: DataFrame, first: int, last: int) -> DataFrame:
    """The states after a pass: per window the bucket that holds the row wanted last."""
    total = F.sum("n").over(Window.partitionBy("anchor", "w").orderBy("digit"))
    hit = counts.select("*", total.alias("upto")).join(states.select("anchor", "w", "need"), ["anchor", "w"]).where("upto >= need AND upto - n < need")
    x = states.join(hit.select("anchor", "w", "digit", "upto", "n"), ["anchor", "w"], "left")
    width = F.when(F.col("by_id"), _width("first", "last")).otherwise(_width("low", "high"))
    x = x.withColumn("width", width).withColumn("few", F.col("k") - F.col("need") + F.col("upto") <= GATHER)
    # in wide decimals: ids may lie anywhere in 64 bits
    step = F.col("digit").cast("decimal(20,0)") * F.col("width").cast("decimal(20,0)")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    high = (wide("high") - step).cast("long")
    low = F.greatest(F.col("low"), high - F.col("width") + 1)
    first_id = wide("first") + step
    last_id = F.least(wide("last"), first_id + wide("width") - 1).cast("long")
    missing = F.col("digit").isNull()  # fewer rows than wanted: all of them
    one = F.col("width") == 1
    by_score = F.struct(
        low.alias("low"), F.when(one & ~F.col("few"), low).otherwise(high).alias("high"), (one & ~F.col("few")).alias("by_id"), F.lit(first).cast("long").alias("first"), F.lit(last).cast("long").alias("last"),
        (F.col("need") - F.col("upto") + F.col("n")).alias("need"), F.col("few").alias("settled"),
    )
    by_id = F.struct(
        F.col("low").alias("low"), F.col("high").alias("high"), F.lit(True).alias("by_id"), first_id.cast("long").alias("first"), last_id.alias("last"),
        (F.col("need") - F.col("upto") + F.col("n")).alias("need"), (F.col("few") | one).alias("settled"),
    )
    as_is = F.struct("low", "high", "by_id", "first", "last", "need", F.lit(True).alias("settled"))
    return x.select("anchor", "w", "same", "k", "top", F.when(missing, as_is).when(F.col("by_id"), by_id).otherwise(by_score).alias("s")).select("anchor", "w", "same", "k", "top", "s.*").select(*_STATE)


def select(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """``(anchor, w, id, score, rank)``: of every window its first k rows, by score from above, then by id.

    ``rows`` are those of :func:`quantised`; ``windows`` has ``anchor, w`` (together a
    key), ``same`` (rows of the anchor's label but itself, or those of other labels),
    ``low`` and ``high`` (the scores that count, both included) and ``k``.
    """
    n, dim, first, last = rows.agg(F.count(F.lit(1)), F.max("dim"), F.min("id"), F.max("id")).first()
    if not n:
        first = last = dim = 0
    spark = rows.sparkSession
    size = max(1, TILE // max(1, dim))
    groups = max(-(-n // size), min(2 * spark.sparkContext.defaultParallelism, -(-n // 1024)), 1)
    states = windows.where("low <= high").select(
        "anchor", "w", "same", "k", F.col("high").alias("top"), "low", "high", F.lit(False).alias("by_id"), F.lit(first).cast("long").alias("first"), F.lit(_LAST).alias("last"),
        F.col("k").cast("long").alias("need"), F.lit(False).alias("settled"),
    ).select(*_STATE)
    states = materialise(states, "windows")
    anchors = states.select("anchor").distinct().count()
    blocks = max(1, -(-anchors // size))

    def asked(s: DataFrame, *more: Column) -> DataFrame:
        """Each anchor with its windows; an anchor has few."""
        packed = s.groupBy("anchor").agg(F.collect_list(F.struct("w", "same", "top", "low", "high", "by_id", "first", "last", *more)).alias("windows"))
        return packed.join(rows, F.col("anchor") == F.col("id")).drop("anchor")

    done = []
    while True:
        open_ = states.where("NOT settled")
        if open_.isEmpty():
            done.append(states)
            break
        width = F.when(F.col("by_id"), _width("first", "last")).otherwise(_width("low", "high")).alias("width")
        counts = _pairs(rows, asked(open_, width), _counted, "anchor long, w long, digit long, n long", groups, blocks)
        counts = counts.groupBy("anchor", "w", "digit").agg(F.sum("n").alias("n"))
        done.append(states.where("settled"))
        states = materialise(_narrowed(open_, counts, first, last), "windows")
    settled = done[0]
    for d in done[1:]:
        settled = settled.union(d)
    found = _pairs(rows, asked(settled), _gathered, "anchor long, w long, id long, score long", groups, blocks)
    rank = F.row_number().over(Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).join(settled.select("anchor", "w", "k"), ["anchor", "w"]).where("rank <= k").drop("k")


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, of: int = 100) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``rows`` are those of :func:`quantised`, ``anchors`` a condition on their ``id``.
    A negative's score lies between ``low / of`` and ``high / of`` of the positive's.
    """
    widest = rows.agg(F.max(F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x.cast("long")))).first()[0] or 0
    near = rows.where(anchors).select(F.col("id").alias("anchor"), F.lit(0).cast("long").alias("w"), F.lit(True).alias("same"), F.lit(-widest).cast("long").alias("low"), F.lit(widest).cast("long").alias("high"), F.lit(positives).alias("k"))
    pairs = materialise(select(rows, near).select("anchor", F.col("id").alias("w"), F.col("score").alias("positive_score")), "positives")
    # a negative score has an empty window, for its low end lies above its high end
    windows = pairs.where("positive_score >= 0").selectExpr("anchor", "w", "false AS same", f"({low} * positive_score + {of - 1}) div {of} AS low", f"({high} * positive_score) div {of} AS high", f"{negatives} AS k")
    found = select(rows, windows)
    return found.join(pairs, ["anchor", "w"]).select(F.col("anchor").alias("anchor_id"), F.col("w").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the ids divisible by 100; a seventh of the labels is wrong on purpose."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label)
    return mine(rows, F.col("id") % 100 == 0)


SQL = """
WITH rows AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), pairs AS (
  SELECT a.id AS anchor_id, r.id AS id, a.label = r.label AS same, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score
  FROM rows a JOIN rows r ON len(a.q) = len(r.q) AND a.id <> r.id WHERE a.id % 100 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id, positive_score, n.score AS negative_score
FROM positives JOIN pairs n USING (anchor_id)
WHERE NOT n.same AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 10
"""

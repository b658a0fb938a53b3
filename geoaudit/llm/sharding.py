"""Uniform shuffle into shards of exact size by a communication matrix.

Rows lie in virtual partitions (by a hash of their identity, about
``ROWS_A_CELL`` rows each).  How many rows of each partition go to each shard
is drawn from the multivariate hypergeometric law, so that row and column sums
are exact; rows are permuted within their partition and dealt out by those
counts, exchanged, and permuted again within their shard.  Every arrangement
with these shard sizes is then equally likely, given random keys, and shard
sizes differ by one row at most.

The matrix is the only thing the driver holds: one row per virtual partition
and one column per shard.  Within a shard the second permutation is a random
cell followed by a random order in it, so that no task sorts a whole shard.

Defined results: rows are told apart by all their columns, and rows that are
alike throughout get different slots; nulls in any column are values like any
other; an empty table gives an empty result; input columns named ``shard`` or
``slot`` are replaced.  The same seed and rows give the same shards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoaudit.llm._frames import col
from geoaudit.session import table

#: Rows that a virtual partition, or a cell of a shard, has on average.
ROWS_A_CELL = 2048
#: Most virtual partitions, so that the matrix stays small on the driver.
MOST_PARTITIONS = 1 << 17


def shard_sizes(n: int, shards: int) -> np.ndarray:
    """Sizes of the shards: equal, the first ones with one row more."""
    return np.full(shards, n // shards) + (np.arange(shards) < n % shards)


def matrix(rows: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Counts from each partition to each shard with the given row and column sums.

    Rows are drawn one after the other: what partition p sends is a draw without
    replacement from the places that earlier partitions have left.
    """
    draw = np.random.Generator(np.random.Philox(seed))
    left = sizes.copy()
    out = np.zeros((len(rows), len(sizes)), np.int64)
    for p, n in enumerate(rows):
        out[p] = draw.multivariate_hypergeometric(left, n, method="marginals") if n else 0
        left -= out[p]
    return out


def shard(df: DataFrame, shards: int, seed: int = 42, key: str | None = None) -> DataFrame:
    """Append ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in each shard).

    ``key`` names a column that tells rows apart well enough to seed their
    random order (ties are broken by all columns); without it all columns do.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    # the row travels as one value, so that no name of its columns can clash with those here
    base = df.select(F.struct(*map(col, kept)).alias("row"))
    field = lambda c: F.col("row." + "`" + c.replace("`", "``") + "`")
    every = [field(c) for c in kept]
    identity = [field(key)] if key else every
    # one pass over the keys alone: how many rows, then how many in each virtual partition
    n = base.count()
    if not n:
        return df.select(*map(col, kept), F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot"))
    parts = int(min(max(1, -(-n // ROWS_A_CELL)), MOST_PARTITIONS))
    cells = int(max(1, -(-n // (ROWS_A_CELL * shards))))
    virtual = F.pmod(F.xxhash64(*identity, F.lit(seed)), F.lit(parts)).cast("int")
    counted = base.select(virtual.alias("p")).groupBy("p").count().collect()  # one row per virtual partition
    rows = np.zeros(parts, np.int64)
    for r in counted:
        rows[r["p"]] = r["count"]
    drawn = matrix(rows, shard_sizes(n, shards), seed)
    edges = np.cumsum(drawn, axis=1)
    # the last rank of each shard within a partition, as one array per partition
    plan = spark.createDataFrame([(p, e) for p, e in enumerate(edges.tolist())], "q int, edges array<bigint>")
    first = F.xxhash64(*identity, F.lit(seed + 1))
    local = Window.partitionBy("p").orderBy(first, F.xxhash64(*every))
    ranked = base.withColumn("p", virtual).withColumn("r", F.row_number().over(local))
    # shards whose last rank lies below this row's
    number = F.size(F.filter("edges", lambda e: e < F.col("r"))).cast("int")
    sent = ranked.join(F.broadcast(plan) if parts * shards <= 1 << 17 else plan, F.col("p") == F.col("q")).withColumn("shard", number)
    second = F.xxhash64(F.col("p"), F.col("r"), F.lit(seed + 2))
    sent = sent.withColumn("c", F.pmod(second, F.lit(cells)).cast("int")).withColumn("o", F.xxhash64(second, F.lit(seed + 3))).drop("edges", "q")
    within = Window.partitionBy("shard", "c").orderBy("o", "p", "r")
    # where each cell begins in its shard: from (partition, rank) alone, without the rows
    sizes = _cell_sizes(plan, cells, seed)
    offsets = sizes.withColumn("first", F.sum("n").over(Window.partitionBy("s").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)))
    offsets = offsets.select("s", "k", F.coalesce("first", F.lit(0)).alias("first"))
    placed = sent.withColumn("i", F.row_number().over(within)).join(F.broadcast(offsets) if shards * cells <= 1 << 17 else offsets, (F.col("shard") == F.col("s")) & (F.col("c") == F.col("k")))
    return placed.select(*(field(c).alias(c) for c in kept), "shard", (F.col("first") + F.col("i") - 1).cast("long").alias("slot"))


def _cell_sizes(plan: DataFrame, cells: int, seed: int) -> DataFrame:
    """Rows in each cell of each shard: the cell of a row depends on its partition and rank only."""
    ranks = plan.withColumn("r", F.explode(F.sequence(F.lit(1), F.greatest(F.element_at("edges", -1), F.lit(1)).cast("int"))))
    ranks = ranks.where(F.col("r") <= F.element_at("edges", -1))
    cell = F.pmod(F.xxhash64(F.col("q"), F.col("r"), F.lit(seed + 2)), F.lit(cells)).cast("int")
    number = F.size(F.filter("edges", lambda e: e < F.col("r"))).cast("int")
    return ranks.groupBy(number.alias("s"), cell.alias("k")).agg(F.count(F.lit(1)).alias("n"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffle all of ``documents`` into shards 0 to 7 whose counts differ by one at most.

    The texts travel with their rows; size and checksum are taken from them at
    their destination.
    """
    done = shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 8, key="doc_id")
    raw = F.coalesce("text", F.lit("")).cast("binary")
    return done.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

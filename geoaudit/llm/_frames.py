"""Columns by their plain names, and columns appended batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """The column of this name, whatever signs the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def append(df: DataFrame, taken: str, added: T.StructType, f: Callable[[pa.Array], list[pa.Array]], rows: int = 1 << 20) -> DataFrame:
    """Append the columns ``added`` that ``f`` makes of column ``taken``, ``rows`` rows at most at a time.

    Other columns pass through under whatever names they have; those named like
    the added ones (in any case) are replaced.
    """
    names, new = df.columns, [a.lower() for a in added.names]
    if taken.lower() in new:
        raise ValueError(f"column {taken!r} cannot be both input and output")
    kept = [i for i, c in enumerate(names) if c.lower() not in new]
    at = kept.index(names.index(taken))
    plain = df.toDF(*(f"c{i}" for i in range(len(names)))).select(*(f"c{i}" for i in kept))
    shape = T.StructType([*plain.schema.fields, *(T.StructField(f"o{k}", a.dataType) for k, a in enumerate(added.fields))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, rows):
                part = b.slice(i, rows)
                yield pa.RecordBatch.from_arrays([*part.columns, *f(part.column(at))], names=shape.names)

    return plain.mapInArrow(run, shape).toDF(*(names[i] for i in kept), *added.names)

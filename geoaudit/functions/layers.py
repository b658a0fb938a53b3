"""Spectral layers of a composite cell as a table function: its schema is settled when the query is analysed.

``spectral_layers(bands, names)`` gives a row for each asked layer of a cell; joined
laterally, it makes a long table of layers from a table of cells.  Values are not
freed of the radiometric offset (encoders do that, point features do not).  A layer
that is not known, or names that are not a constant, fail when the query is analysed,
before any row is read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: Places (from 1) of the twelve bands' single layers, and the normalised differences (first, second).
SINGLE = {"blue": 2, "green": 3, "red": 4, "nir_narrow": 9, "swir1": 11, "swir2": 12}
RATIO = {"ndvi": (8, 4), "nbr": (9, 12)}
LAYERS = [*SINGLE, *RATIO]


class SpectralLayers:
    """The handler: scaled bands and normalised differences; a layer with a missing band is null."""

    @staticmethod
    def analyze(bands: AnalyzeArgument, names: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(bands.dataType, T.ArrayType):
            raise ValueError(f"bands are an array, not {bands.dataType.simpleString()}")
        if not names.isConstantExpression or not isinstance(names.value, str):
            raise ValueError("the names of layers are a constant text")
        if unknown := [n for n in names.value.split(",") if n not in LAYERS]:
            raise ValueError(f"unknown layers: {', '.join(unknown)}")
        return AnalyzeResult(schema=T.StructType([T.StructField("layer", T.StringType()), T.StructField("value", T.DoubleType())]))

    def eval(self, bands: list[float] | None, names: str) -> Iterator[tuple[str, float | None]]:
        def at(place: int) -> float | None:
            x = bands[place - 1] if bands is not None and len(bands) >= place else None
            return None if x is None else float(x) / 10_000.0

        for name in names.split(","):
            if name in SINGLE:
                yield name, at(SINGLE[name])
            else:
                a, b = map(at, RATIO[name])
                yield name, None if a is None or b is None else (a - b) / (a + b + 1e-6)


def spectral(cells: DataFrame, bands: str, names: list[str] = LAYERS) -> DataFrame:
    """``cells`` with a row for each layer: ``layer, value``; cells without bands keep their rows, with null values."""
    function = F.udtf(SpectralLayers)
    return cells.lateralJoin(function(F.col(bands).outer(), F.lit(",".join(names)))).drop(bands)

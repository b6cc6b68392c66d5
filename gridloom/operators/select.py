"""Selection and projection of array cells: hyperslabs, planes, orientation, calibration, masks, composites.

Cells are rows of integer index columns and a value ``v``; chunks are rows with an array of values.  A missing value is null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scale import finite


@dataclass(frozen=True)
class Index:
    """One place on a dimension."""

    at: int

    def bounds(self) -> tuple[int, int]:
        return self.at, self.at + 1


@dataclass(frozen=True)
class Range:
    """Places start to stop, without stop."""

    start: int
    stop: int

    def bounds(self) -> tuple[int, int]:
        return self.start, self.stop


def clamp_request(s, size: int):
    """A request on a dimension of ``size`` places, moved inside it; at least one place is left."""
    if isinstance(s, Index):
        return Index(min(s.at, size - 1))
    start = min(s.start, size - 1)
    return Range(start, min(max(s.stop, start + 1), size))


def clamp_projection(s, size: int):
    """As :func:`clamp_request`, but the result may be empty."""
    start, stop = s.bounds()
    start = min(start, size)
    return Range(start, max(start, min(stop, size)))


def select(cells: DataFrame, **selections) -> DataFrame:
    """Keep the cells inside every selection; the conditions are plain comparisons, so they reach a Parquet scan."""
    for dim, s in selections.items():
        start, stop = s.bounds()
        cells = cells.where(F.col(dim) == start if isinstance(s, Index) else (F.col(dim) >= start) & (F.col(dim) < stop))
    return cells


def chunk_range(s, chunk: int) -> tuple[int, int]:
    """First and last chunk that a selection touches."""
    start, stop = s.bounds()
    return start // chunk, (stop - 1) // chunk


def select_chunks(chunks: DataFrame, sizes: dict[str, int], **selections) -> DataFrame:
    """Keep the chunk rows (index columns c_<dim>) that the selections touch: the part of a cell predicate that a scan can use."""
    for dim, s in selections.items():
        first, last = chunk_range(s, sizes[dim])
        chunks = chunks.where(F.col(f"c_{dim}").between(first, last))
    return chunks


def rows_to_cells(rows: DataFrame, y: str, values: str, x: Range | None = None) -> DataFrame:
    """Cells (y, x, v) of rows that each hold one line of a matrix; only the wanted part of a line is unfolded."""
    line = F.col(values) if x is None else F.slice(values, x.start + 1, x.stop - x.start)
    first = 0 if x is None else x.start
    return rows.select(F.col(y).cast("long").alias("y"), F.posexplode(line)).select("y", (F.col("pos") + first).cast("long").alias("x"), F.col("col").cast("double").alias("v"))


def transpose(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("x").alias("y"), F.col("y").alias("x"), "v")


def flip(cells: DataFrame, dim: str, size: int) -> DataFrame:
    return cells.withColumn(dim, (F.lit(size - 1) - F.col(dim)).cast("long"))


def shift(cells: DataFrame, dim: str, by: int, size: int) -> DataFrame:
    """Circular shift along a dimension."""
    return cells.withColumn(dim, F.pmod(F.col(dim) + by, F.lit(size)).cast("long"))


def calibrate(raw: Column, factor: float | None = None, offset: float | None = None, fill: float | None = None, low: float | None = None, high: float | None = None) -> Column:
    """Packed values to real ones: fill and out-of-range values (tested as packed) are missing."""
    value = raw.cast("double")
    ok = ~F.isnan(value)
    if fill is not None:
        ok = ok & (F.abs(value - fill) > max(abs(fill) * 1e-5, 1e-12))
    if low is not None:
        ok = ok & (value >= low)
    if high is not None:
        ok = ok & (value <= high)
    out = value if factor is None else value * factor
    return F.when(ok, out if offset is None else out + offset)


def visible(v: Column, low: float, high: float, show_missing: bool = False, show_low: bool = False, show_high: bool = False) -> Column:
    """Whether a value is drawn."""
    missing = finite(v).isNull() | (F.abs(v) > 1e30)
    return F.when(missing, F.lit(show_missing)).when(v < low, F.lit(show_low)).when(v > high, F.lit(show_high)).otherwise(F.lit(True))


def crop(cells: DataFrame, width: int, height: int, left: float, top: float, right: float, bottom: float) -> DataFrame:
    """The cells of a box given in parts of the picture, at least five hundredths wide and high."""
    left, top = min(max(left, 0.0), 0.95), min(max(top, 0.0), 0.95)
    right, bottom = max(min(right, 1.0), left + 0.05), max(min(bottom, 1.0), top + 0.05)
    x0, x1, y0, y1 = int(left * width), -int(-right * width // 1), int(top * height), -int(-bottom * height // 1)
    out = select(cells, x=Range(x0, x1), y=Range(y0, y1))
    return out.withColumns({"x": (F.col("x") - x0).cast("long"), "y": (F.col("y") - y0).cast("long")})


def bands_to_columns(cells: DataFrame, band: str, n: int, keys: list[str]) -> DataFrame:
    """One row per cell with columns b0, b1, ...; one shuffle."""
    return cells.groupBy(*keys).agg(*[F.max(F.when(F.col(band) == k, F.col("v"))).alias(f"b{k}") for k in range(n)])

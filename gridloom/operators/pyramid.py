"""Multi-resolution pyramids and viewport sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom import ship
from gridloom.functions.scale import finite


def halve(cells: DataFrame, how: str = "mean", keys: tuple[str, ...] = ()) -> DataFrame:
    """Cells of half the resolution: mean, max or min of the finite values of each 2 x 2 box, or its first cell as it is."""
    y, x = (F.floor(F.col(c) / 2).cast("long").alias(c) for c in ("y", "x"))
    if how == "nearest":
        return cells.where("y % 2 = 0 AND x % 2 = 0").select(*keys, y, x, "v")
    return cells.groupBy(*keys, y, x).agg({"mean": F.avg, "max": F.max, "min": F.min}[how](finite(F.col("v"))).alias("v"))


def level_sizes(width: int, height: int, least: int) -> list[tuple[int, int]]:
    """Width and height of every level, the full one first, until both are ``least`` or less."""
    out = [(width, height)]
    while max(out[-1]) > least:
        out.append((-(-out[-1][0] // 2), -(-out[-1][1] // 2)))
    return out


def build(cells: DataFrame, width: int, height: int, least: int, how: str = "mean", keep=lambda level: level) -> DataFrame:
    """level, y, x, v of all levels.  ``keep`` may store a level (checkpoint or Parquet) so that the next starts from it."""
    out = cells.select(F.lit(0).alias("level"), "y", "x", "v")
    level = cells.select("y", "x", "v")
    for k in range(1, len(level_sizes(width, height, least))):
        level = keep(halve(level, how))
        out = out.unionByName(level.select(F.lit(k).alias("level"), "y", "x", "v"))
    return out


def write(pyramid: DataFrame, path: str) -> None:
    """Parquet by level, so that a reader of one level prunes the others."""
    pyramid.write.partitionBy("level").parquet(path)


def level_for(span: float, pixels: int, n_levels: int) -> int:
    """Last level whose cells are at most 1.25 times as wide as a pixel of a view ``span`` full-resolution cells wide."""
    rate = span / pixels
    best = 0
    for k in range(n_levels):
        if 2**k <= 1.25 * rate:
            best = k
    return best


def viewport(level: DataFrame, level_width: int, level_height: int, x0: float, x1: float, y0: float, y1: float, out_w: int, out_h: int) -> DataFrame:
    """py, px, v of a picture over the box (in parts of the whole); each pixel reads its nearest cell."""
    spark = level.sparkSession
    px = spark.range(out_w).select(F.col("id").alias("px"), F.least(F.floor((x0 + (F.col("id") + 0.5) / out_w * (x1 - x0)) * level_width), F.lit(level_width - 1)).cast("long").alias("x"))
    py = spark.range(out_h).select(F.col("id").alias("py"), F.least(F.floor((y0 + (F.col("id") + 0.5) / out_h * (y1 - y0)) * level_height), F.lit(level_height - 1)).cast("long").alias("y"))
    # Two joins on one index each: a pixel row or column table is at most as long as the picture is wide or high.
    return level.join(F.broadcast(px), "x").join(F.broadcast(py), "y").select("py", "px", "v")


# --- all levels from chunks, in one pass -------------------------------------------------------------------------------

#: Levels that one group of upper cells gives: groups have at most 4 ** UPPER cells.
UPPER = 6
HOWS = ("mean", "max", "min", "nearest")
ROWS = "how string, level int, origin array<long>, shape array<long>, values array<double>"


def fold(block: np.ndarray, how: str) -> np.ndarray:
    """Half the resolution of a block, as :func:`halve` does; missing values are NaN."""
    if how == "nearest":
        return block[::2, ::2]
    padded = np.pad(block, [(0, n % 2) for n in block.shape], constant_values=np.nan)
    padded = np.where(np.isfinite(padded), padded, np.nan)
    boxes = padded.reshape(padded.shape[0] // 2, 2, padded.shape[1] // 2, 2).transpose(0, 2, 1, 3).reshape(padded.shape[0] // 2, padded.shape[1] // 2, 4)
    some = ~np.isnan(boxes).all(axis=2)
    out = np.full(some.shape, np.nan)
    out[some] = {"mean": np.nanmean, "max": np.nanmax, "min": np.nanmin}[how](boxes[some], axis=1)
    return out


def _rows(items) -> pa.RecordBatch:
    columns = list(zip(*items, strict=True)) or [[]] * 5
    types = [pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["how", "level", "origin", "shape", "values"])


def fold_chunks(chunks: DataFrame, size: int, n_levels: int, hows: tuple[str, ...] = HOWS) -> DataFrame:
    """how, level, origin, shape and values: every level that a chunk (c_y, c_x, shape, values; ``size`` wide and high, a power of two) has by itself,
    down to one cell.  Nothing is shuffled."""
    ship(chunks.sparkSession)
    own = min(size.bit_length() - 1, n_levels - 1)

    def run(batches):
        for b in batches:
            items = []
            for y, x, shape, values in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                first = values.values.to_numpy(zero_copy_only=False).reshape(shape)
                for how in hows:
                    block = first
                    for level in range(own + 1):
                        items.append((how, level, [y * size >> level, x * size >> level], list(block.shape), block.ravel()))
                        block = fold(block, how)
            yield _rows(items)

    return chunks.select("c_y", "c_x", "shape", "values").mapInArrow(run, ROWS)


def _fold_up(level: int, steps: int):
    """A group of single cells of a level to the next ``steps`` levels."""
    side = 1 << steps

    def run(group: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(group["y"].min()) // side * side, int(group["x"].min()) // side * side
        block = np.full((side, side), np.nan)
        there = np.zeros((side, side), bool)
        at = group["y"].to_numpy() - y0, group["x"].to_numpy() - x0
        block[at], there[at] = group["v"].to_numpy(), True
        how, out = group["how"].iloc[0], []
        for k in range(1, steps + 1):
            block = fold(block, how)
            there = np.pad(there, [(0, n % 2) for n in there.shape])
            there = there[::2, ::2] if how == "nearest" else there[::2, ::2] | there[1::2, ::2] | there[::2, 1::2] | there[1::2, 1::2]
            for y, x in np.argwhere(there):
                out.append((how, level + k, [(y0 >> k) + int(y), (x0 >> k) + int(x)], [1, 1], [block[y, x]]))
        return pd.DataFrame(out, columns=["how", "level", "origin", "shape", "values"])

    return run


def store(chunks: DataFrame, path: str, size: int, n_levels: int, hows: tuple[str, ...] = HOWS) -> DataFrame:
    """Write all levels of a 2-D array to ``path``, Parquet by how and level, and return them.

    The chunks are read once: each gives its own levels down to one cell.  From there on only these cells move, one a chunk, grouped by squares of
    2 ** UPPER to a side (the leading bits of their Morton numbers), and each group gives the next UPPER levels; the exchanges are of single
    cells, and as many as the logarithm of the number of chunks to the base of a group."""
    spark = chunks.sparkSession
    fold_chunks(chunks, size, n_levels, hows).write.partitionBy("how", "level").parquet(path)
    schema = "origin array<long>, shape array<long>, values array<double>, how string, level int"
    level = size.bit_length() - 1
    while level < n_levels - 1:
        steps = min(UPPER, n_levels - 1 - level)
        last = spark.read.schema(schema).parquet(path).where(F.col("level") == level)
        cells = last.select("how", F.element_at("origin", 1).alias("y"), F.element_at("origin", 2).alias("x"), F.element_at("values", 1).alias("v"))
        square = [F.shiftright(c, steps).alias(f"_{c}") for c in ("y", "x")]
        upper = cells.groupBy("how", *square).applyInPandas(_fold_up(level, steps), ROWS)
        # Pandas gives back a missing value as null.
        upper.withColumn("values", F.transform("values", lambda v: F.coalesce(v, F.lit(float("nan"))))).write.mode("append").partitionBy("how", "level").parquet(path)
        level += steps
    return spark.read.schema(schema).parquet(path)

"""Stencils on chunks: neighbours exchange their border layers, then each chunk is worked on whole.

What goes from chunk to chunk is the surface, not the cells: a chunk sends one layer to each of the neighbours that it touches by a face,
an edge or a corner (``halos``), a chunk meets the layers sent to it by an equi-join, and a vectorised kernel runs over the block with its
rim (``gradient``).
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom import ship

NUMBERS = pa.list_(pa.int64())
VALUES = pa.list_(pa.float64())


def to_chunks(cells: DataFrame, axes: dict[str, int], sizes: dict[str, int], value: str = "v") -> DataFrame:
    """Chunk rows (c_<dim>, shape, values in row-major order) of cells; missing cells are NaN.  ``axes``: length of each dimension; ``sizes``: that of
    a chunk."""
    ship(cells.sparkSession)
    names, lengths, steps = list(axes), list(axes.values()), [sizes[d] for d in axes]
    place = F.lit(0).cast("long")
    for d, n in zip(names, steps, strict=True):
        place = place * n + F.col(d) % n
    keys = [F.floor(F.col(d) / n).cast("long").alias(f"c_{d}") for d, n in zip(names, steps, strict=True)]
    grouped = cells.groupBy(*keys).agg(F.collect_list(place).alias("at"), F.collect_list(F.coalesce(F.col(value).cast("double"), F.lit(float("nan")))).alias("v"))

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                chunk = [b.column(k)[row].as_py() for k in range(len(names))]
                shape = [min(n, whole - c * n) for c, n, whole in zip(chunk, steps, lengths, strict=True)]
                block = np.full(steps, np.nan)
                block.reshape(-1)[b.column(len(names))[row].values.to_numpy()] = b.column(len(names) + 1)[row].values.to_numpy()
                block = block[tuple(slice(0, n) for n in shape)]
                yield pa.RecordBatch.from_arrays([*[pa.array([c], pa.int64()) for c in chunk], pa.array([shape], NUMBERS), pa.array([block.ravel()], VALUES)], [*[f"c_{d}" for d in names], "shape", "values"])

    return grouped.mapInArrow(run, ", ".join(f"`c_{d}` long" for d in names) + ", shape array<long>, values array<double>")


def _block(b: pa.RecordBatch, row: int, dims: int) -> tuple[list[int], np.ndarray]:
    return [b.column(k)[row].as_py() for k in range(dims)], b.column(dims + 1)[row].values.to_numpy(zero_copy_only=False).reshape(b.column(dims)[row].as_py())


def halos(chunks: DataFrame, grid: dict[str, int]) -> DataFrame:
    """c_<dim> of the chunk that gets a layer, ``side`` where it lies there (-1, 0 or 1 in each dimension), and its shape and values.
    ``grid``: chunks in each dimension."""
    ship(chunks.sparkSession)
    names, counts = list(grid), list(grid.values())
    sides = [s for s in product((-1, 0, 1), repeat=len(names)) if any(s)]

    def run(batches):
        for b in batches:
            columns = [[] for _ in range(len(names) + 3)]
            for row in range(b.num_rows):
                chunk, block = _block(b, row, len(names))
                for side in sides:
                    to = [c - s for c, s in zip(chunk, side, strict=True)]
                    if all(0 <= c < n for c, n in zip(to, counts, strict=True)):
                        # What lies above a chunk is the first layer of the one above it.
                        layer = block[tuple(slice(None) if s == 0 else slice(0, 1) if s == 1 else slice(-1, None) for s in side)]
                        for column, x in zip(columns, (*to, list(side), list(layer.shape), layer.ravel()), strict=True):
                            column.append(x)
            types = [*[pa.int64()] * len(names), NUMBERS, NUMBERS, VALUES]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [*[f"c_{d}" for d in names], "side", "shape", "values"])

    keys = [f"c_{d}" for d in names]
    return chunks.select(*keys, "shape", "values").mapInArrow(run, ", ".join(f"`{k}` long" for k in keys) + ", side array<long>, shape array<long>, values array<double>")


def rimmed(block: np.ndarray, chunk: list[int], counts: list[int], layers) -> np.ndarray:
    """A block with the layers around it; beyond the array's edge its cells repeat, and chunks that are not there count as 0."""
    out = np.zeros([n + 2 for n in block.shape])
    out[(slice(1, -1),) * block.ndim] = block
    for side, layer in layers:
        out[tuple(slice(1, -1) if s == 0 else slice(0, 1) if s == -1 else slice(-1, None) for s in side)] = layer
    out = np.nan_to_num(out, nan=0.0, posinf=np.inf, neginf=-np.inf)
    for k, (c, n) in enumerate(zip(chunk, counts, strict=True)):
        along = np.moveaxis(out, k, 0)
        if c == 0:
            along[0] = along[1]
        if c == n - 1:
            along[-1] = along[-2]
    return out


def sobel(rim: np.ndarray) -> list[np.ndarray]:
    """Sobel's gradient of the block inside a rim, one array a dimension."""
    n = rim.ndim
    inside = lambda a, k, s: a[tuple(slice(1 + s, a.shape[k] - 1 + s) if j == k else slice(None) for j in range(n))]
    out = []
    for k in range(n):
        g = inside(rim, k, -1) - inside(rim, k, 1)
        for j in range(n):
            if j != k:
                g = inside(g, j, -1) + 2 * inside(g, j, 0) + inside(g, j, 1)
        out.append(g)
    return out


def gradient(chunks: DataFrame, grid: dict[str, int], sizes: dict[str, int]) -> DataFrame:
    """Chunk rows with origin, shape and g_<dim>, the gradient of each cell by Sobel's stencil; missing cells count as 0."""
    names, keys = list(grid), [f"c_{d}" for d in grid]
    sent = halos(chunks, grid).groupBy(*keys).agg(F.collect_list(F.struct("side", F.col("shape").alias("s"), F.col("values").alias("v"))).alias("layers"))
    met = chunks.select(*keys, "shape", "values").join(sent, keys, "left")
    counts, steps = list(grid.values()), [sizes[d] for d in grid]

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                chunk, block = _block(b, row, len(names))
                layers = [(x["side"], np.array(x["v"]).reshape(x["s"])) for x in b.column(len(names) + 2)[row].as_py() or ()]
                found = sobel(rimmed(block, chunk, counts, layers))
                origin = [c * n for c, n in zip(chunk, steps, strict=True)]
                values = [pa.array([g.ravel()], VALUES) for g in found]
                yield pa.RecordBatch.from_arrays([*[pa.array([c], pa.int64()) for c in chunk], pa.array([origin], NUMBERS), pa.array([list(block.shape)], NUMBERS), *values], [*keys, "origin", "shape", *[f"g_{d}" for d in names]])

    return met.mapInArrow(run, ", ".join(f"`{k}` long" for k in keys) + ", origin array<long>, shape array<long>, " + ", ".join(f"`g_{d}` array<double>" for d in names))


def to_cells(chunks: DataFrame, dims: list[str], values: list[str]) -> DataFrame:
    """One row a cell of chunk rows with several arrays of values."""
    flat = chunks.select("origin", "shape", F.posexplode(F.arrays_zip(*values)).alias("_p", "_v"))
    stride, out = F.lit(1), []
    for k in range(len(dims) - 1, -1, -1):
        n = F.element_at("shape", k + 1)
        out.append((F.element_at("origin", k + 1) + F.pmod(F.floor(F.col("_p") / stride), n)).cast("long").alias(dims[k]))
        stride = stride * n
    return flat.select(*reversed(out), *[F.col(f"_v.{v}").alias(v) for v in values])

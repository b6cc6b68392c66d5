"""``spark.read.format("gridloom_zarr")``: arrays of Zarr stores as a Python data source with planned partitions.

The schema comes from one metadata document of the array.  Partitions are ranges of chunk numbers inside the box that the pushed
filters leave: they are computed from the array's shape, no folder is ever listed, and a task opens the files of its own chunks
only.  Where files are shards, the chunks are those inside them, and a task reads an index and the ranges of its chunks.  A chunk without a file holds the fill value.

Options: ``variable`` (path of the array in the store), ``rows`` (``cells``: one index column a dimension and v; ``chunks``: c_<dim>, origin,
shape and values), ``calibrate`` and ``verify`` as for ``zarr.chunks``, ``bytes`` (decoded bytes a partition, about).  Filters on index columns
(=, <, <=, >, >=, IN) reach the plan of partitions; Spark applies them again to the rows.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from gridloom.sources import zarr

FORMAT = "gridloom_zarr"
BYTES = 64 << 20


@dataclass
class Run(InputPartition):
    """Chunks ``first`` to ``last`` (excluded) of the planned box, in row-major order."""

    first: int
    last: int


def _bounds(f) -> tuple[int, int] | None:
    """Lowest and highest integer that a filter lets through; None where it tells nothing."""
    if not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual)):
        return None
    values = f.value if isinstance(f, In) else (f.value,)
    if not values or any(v is None or isinstance(v, (bool, str, bytes)) or v != v or abs(v) > 2**62 for v in values):
        return None
    low, high = min(values), max(values)
    if isinstance(f, (EqualTo, In)):
        return math.ceil(low), math.floor(high)
    if isinstance(f, GreaterThan):
        return math.floor(low) + 1, 2**62
    if isinstance(f, GreaterThanOrEqual):
        return math.ceil(low), 2**62
    if isinstance(f, LessThan):
        return -(2**62), math.ceil(high) - 1
    return -(2**62), math.floor(high)


class ChunkReader(DataSourceReader):
    def __init__(self, store: str, array: tuple, options: dict):
        self.folder = f"{store.rstrip('/')}/{array[0]}" if array[0] else store.rstrip("/")
        self.layout = zarr.Layout(array)
        self.cells = options.get("rows", "cells") == "cells"
        self.calibrate, self.verify = (options.get(k, d).lower() == "true" for k, d in (("calibrate", "true"), ("verify", "false")))
        self.bytes = int(options.get("bytes", BYTES))
        self.box = [(0, -(-n // c)) for n, c in zip(self.layout.shape, self.layout.sizes, strict=True)]

    def pushFilters(self, filters):
        names = {d if self.cells else f"c_{d}": k for k, d in enumerate(self.layout.dims)}
        for f in filters:
            column = getattr(f, "attribute", None)
            if column and len(column) == 1 and column[0] in names and (found := _bounds(f)):
                k = names[column[0]]
                unit = self.layout.sizes[k] if self.cells else 1
                low, high = self.box[k]
                self.box[k] = max(low, found[0] // unit), min(high, found[1] // unit + 1)
            yield f

    def partitions(self):
        total = math.prod(max(0, b - a) for a, b in self.box)
        one = max(1, math.prod(self.layout.sizes) * 8)
        run = max(1, self.bytes // one)
        return [Run(k, min(k + run, total)) for k in range(0, total, run)] or [Run(0, 0)]

    def read(self, partition):
        lay = self.layout
        widths = [b - a for a, b in self.box]
        index_of = functools.lru_cache(maxsize=64)(zarr.shard_index)  # chunks of a shard follow one another, and the store may change later
        for number in range(partition.first, partition.last):
            place, rest = [], number
            for (low, _), width in zip(reversed(self.box), reversed(widths), strict=True):
                rest, at = divmod(rest, width)
                place.insert(0, low + at)
            data = lay.values(lay.content(self.folder, place, self.verify, index_of), place, self.calibrate, self.verify)
            origin = [p * c for p, c in zip(place, lay.sizes, strict=True)]
            if self.cells:
                at = np.indices(data.shape).reshape(data.ndim, -1)
                v = data.ravel()
                index = [pa.array(o + a, pa.int64()) for o, a in zip(origin, at, strict=True)]
                yield pa.RecordBatch.from_arrays([*index, pa.array(v, pa.float64(), mask=np.isnan(v))], [*lay.dims, "v"])
            else:
                index = [pa.array([p], pa.int64()) for p in place]
                yield pa.RecordBatch.from_arrays(
                    [*index, pa.array([origin], pa.list_(pa.int64())), pa.array([list(data.shape)], pa.list_(pa.int64())), pa.array([data.ravel().astype("f4")], pa.list_(pa.float32()))],
                    [*[f"c_{d}" for d in lay.dims], "origin", "shape", "values"],
                )


class ZarrSource(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def _array(self) -> tuple:
        return zarr.open_array(self.options["path"], self.options.get("variable", ""))

    def schema(self):
        dims = zarr.Layout(self._array()).dims
        whole = T.LongType()
        if self.options.get("rows", "cells") == "cells":
            return T.StructType([*[T.StructField(d, whole) for d in dims], T.StructField("v", T.DoubleType())])
        many = [T.StructField(n, T.ArrayType(t)) for n, t in (("origin", whole), ("shape", whole), ("values", T.FloatType()))]
        return T.StructType([*[T.StructField(f"c_{d}", whole) for d in dims], *many])

    def reader(self, schema):
        return ChunkReader(self.options["path"], self._array(), dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to the session.  Spark hands filters to Python sources only where its setting says so, and it is set here."""
    from gridloom import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZarrSource)


def scan(spark: SparkSession, store: str, variable: str, **options):
    """The array as a DataFrame of cells (or chunks)."""
    register(spark)
    reader = spark.read.format(FORMAT).option("variable", variable)
    for k, v in options.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    return reader.load(store)

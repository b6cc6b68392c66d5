"""NetCDF classic files (formats 1, 2 and 5) as tables of variables and chunks, in two phases.

The first reads headers only and tells where the bytes of a selection are (``extents``): one row a step of the leading dimension, or several
where a step is large.  The second deals these rows over the tasks, and each reads its byte ranges; no file is whole in a task.
Newer, HDF5-based files raise.
"""

from __future__ import annotations

import json
import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import ship
from gridloom.operators.select import Index, Range
from gridloom.sources.ranged import Ranged, files, put
from gridloom.sources.zarr import _number, calibrated

# Fixed values of the format: element types by number.
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}


class Unsupported(ValueError):
    """The file is not in the classic format."""


class Header:
    def __init__(self, data):
        if data[0:3] != b"CDF" or data[3:4] not in (b"\1", b"\2", b"\5"):
            raise Unsupported("not a NetCDF classic file")
        self.data, self.at, self.wide, self.far = data, 4, data[3:4] == b"\5", data[3:4] != b"\1"
        self.records = self._count()
        self.dims = self._list(lambda: (self._name(), self._count()))
        self.attributes = dict(self._list(self._attribute))
        self.variables = {v["name"]: v for v in self._list(self._variable)}

    def _int(self, form: str) -> int:
        size = struct.calcsize(form)
        value = struct.unpack(form, self.data[self.at : self.at + size])[0]
        self.at += size
        return value

    def _count(self) -> int:
        return self._int(">q" if self.wide else ">i")

    def _name(self) -> str:
        n = self._count()
        text = self.data[self.at : self.at + n].decode()
        self.at += n + -n % 4
        return text

    def _list(self, item) -> list:
        self._int(">i")
        return [item() for _ in range(self._count())]

    def _attribute(self):
        name, kind, n = self._name(), np.dtype(TYPES[self._int(">i")]), self._count()
        raw = self.data[self.at : self.at + n * kind.itemsize]
        self.at += len(raw) + -len(raw) % 4
        return name, raw.decode("utf-8", "replace").rstrip("\0") if kind.kind == "S" else np.frombuffer(raw, kind).tolist()

    def _variable(self) -> dict:
        name, dims = self._name(), [self._count() for _ in range(self._count())]
        attributes, kind, size = dict(self._list(self._attribute)), self._int(">i"), self._count()
        begin = self._int(">q" if self.far else ">i")
        shape = [self.dims[d][1] for d in dims]
        record = bool(shape) and shape[0] == 0
        return {"name": name, "dims": [self.dims[d][0] for d in dims], "shape": ([self.records] + shape[1:]) if record else shape, "attributes": attributes, "kind": TYPES[kind], "size": size, "begin": begin, "record": record}

    def step(self, v: dict) -> tuple[int, int]:
        """Bytes of one place of the leading dimension, and bytes from one to the next."""
        one = math.prod(v["shape"][1:]) * np.dtype(v["kind"]).itemsize
        together = [x for x in self.variables.values() if x["record"]]
        return one, one if not v["record"] or len(together) == 1 else sum(x["size"] for x in together)

    def values(self, v: dict, start: int, stop: int) -> np.ndarray:
        """Values of places start to stop of the leading dimension, one by one; for short variables."""
        one, far = self.step(v)
        raw = b"".join(self.data[v["begin"] + k * far : v["begin"] + k * far + one] for k in range(start, stop))
        return np.frombuffer(raw, "u1" if v["kind"] == "S1" else v["kind"])


#: Bytes of an extent at most, where the second dimension can be cut.
EXTENT_BYTES = 16 << 20
EXTENTS = "path string, origin array<long>, shape array<long>, offset long, length long, lead double, layout string"


def extents_of(head: Header, variable: str, selections: dict, steps: Range | Index | None = None):
    """origin, shape, offset, length, lead and layout of the byte ranges that hold a selection (by dimension) of a variable.

    A range is contiguous: a step of the leading dimension, and of it the selected places of the second; what is selected of later dimensions is
    cut out when it is read.  ``lead`` is the leading coordinate's value, where the file has that variable."""
    v = head.variables[variable]
    kind = np.dtype("u1" if v["kind"] == "S1" else v["kind"])
    a = {k: _number(v["attributes"].get(k)) for k in ("scale_factor", "add_offset", "valid_min", "valid_max", "_FillValue", "missing_value")}
    layout = {"kind": kind.str, "fill": a["_FillValue"] if a["_FillValue"] is not None else a["missing_value"], "scaling": [a[k] for k in ("scale_factor", "add_offset", "valid_min", "valid_max")]}
    box = []
    for k, (d, n) in enumerate(zip(v["dims"], v["shape"], strict=True)):
        chosen = steps if k == 0 and steps is not None else selections.get(d)
        start, stop = (0, n) if chosen is None else chosen.bounds()
        box.append((min(start, n), max(min(start, n), min(stop, n))))
    if not box:
        yield [], [], v["begin"], kind.itemsize, None, json.dumps(layout)
        return
    one, far = head.step(v)
    (first, last), rest = box[0], v["shape"][1:]
    if not rest and not v["record"]:  # a line: pieces of it
        each = EXTENT_BYTES // kind.itemsize
        for k in range(first, last, each):
            n = min(each, last - k)
            yield [k], [n], v["begin"] + k * kind.itemsize, n * kind.itemsize, None, json.dumps(layout)
        return
    coordinate = head.variables.get(v["dims"][0])
    leads = head.values(coordinate, first, last).astype(float).tolist() if coordinate is not None and len(coordinate["shape"]) == 1 and variable != v["dims"][0] else [None] * (last - first)
    inner = math.prod(rest[1:]) * kind.itemsize
    low, high = box[1] if rest else (0, 1)
    each = max(1, EXTENT_BYTES // max(1, inner))
    layout["later"] = [[n, *b] for n, b in zip(rest[1:], box[2:], strict=True)]
    for k in range(first, last):
        for row in range(low, high, each):
            n = min(each, high - row)
            yield [k, *([row] if rest else []), *[b[0] for b in box[2:]]], [1, *([n] if rest else []), *[b[1] - b[0] for b in box[2:]]], v["begin"] + k * far + row * inner, n * inner, leads[k - first], json.dumps(layout)


def variables(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = []
            for path in b.column(0).to_pylist():
                with Ranged(path) as data:
                    rows += [(path, v["name"], np.dtype(v["kind"]).name, v["shape"], v["dims"], [(k, str(x)) for k, x in v["attributes"].items()]) for v in Header(data).variables.values()]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.map_(pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], ["path", "name", "data_type", "shape", "dims", "attributes"])

    return files(spark, paths).mapInArrow(run, "path string, name string, data_type string, shape array<long>, dims array<string>, attributes map<string,string>")


def extents(spark: SparkSession, paths: str | list[str], variable: str, steps: Range | Index | None = None, **selections: Range | Index) -> DataFrame:
    """Where the bytes of a selection (``steps`` of the leading dimension, others by name) are in every file, from the headers alone."""
    names = [c.split()[0] for c in EXTENTS.split(", ")]
    types = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.float64(), pa.string()]

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                with Ranged(path) as data:
                    rows = [(path, *r) for r in extents_of(Header(data), variable, selections, steps)]
                columns = list(zip(*rows, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    return files(spark, paths).mapInArrow(run, EXTENTS)


def values_of(raw: bytes, shape: list[int], layout: dict) -> np.ndarray:
    """Calibrated values of an extent."""
    data = np.frombuffer(raw, layout["kind"])
    later = layout.get("later", [])
    front = shape[: len(shape) - len(later)]
    data = data.reshape([*front, *[n for n, _, _ in later]])[(..., *[slice(a, b) for _, a, b in later])]
    return calibrated(data.astype(np.float64), layout["fill"], *layout["scaling"])


def read_chunks(found: DataFrame, tasks: int | None = None) -> DataFrame:
    """path, origin, shape, calibrated values and lead of ``found``, a selection of ``extents``; dealt over ``tasks``."""
    tasks = tasks or int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["path", "origin", "shape", "values", "lead"]
    types = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.float64()]

    def run(batches):
        data = opened = None
        for b in batches:
            for path, origin, shape, at, length, lead, layout in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if path != opened:
                    if data is not None:
                        data.file.close()
                    data, opened = Ranged(path), path
                values = values_of(data[at : at + length], shape, json.loads(layout)).ravel().astype("f4")
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((path, origin, shape, values, lead), types, strict=True)], names)

    dealt = found.repartition(tasks, "path", "offset").sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(run, "path string, origin array<long>, shape array<long>, values array<float>, lead double")


def chunks(spark: SparkSession, paths: str | list[str], variable: str, steps: Range | Index | None = None, **selections: Range | Index) -> DataFrame:
    """path, origin, shape and calibrated values of a selection: ``steps`` of the leading dimension, and others by their names.  Bytes outside
    the steps and outside the selected places of the second dimension are not read."""
    return read_chunks(extents(spark, paths, variable, steps, **selections)).drop("lead")


def coordinates(spark: SparkSession, paths: str | list[str], dim: str) -> DataFrame:
    """path, idx, value of a coordinate variable."""
    found = chunks(spark, paths, dim).select("path", F.element_at("origin", 1).alias("first"), F.posexplode("values").alias("idx", "value"))
    return found.select("path", (F.col("first") + F.col("idx")).cast("long").alias("idx"), F.col("value").cast("double").alias("value"))


def encode(dims: list[str], lead: list[float], variable: str, data: np.ndarray, attributes: dict[str, str] | None = None) -> bytes:
    """A file (format 2) with a variable of 32-bit floats and the leading dimension's coordinate."""
    padded = lambda raw: raw + b"\0" * (-len(raw) % 4)
    name = lambda text: struct.pack(">i", len(text.encode())) + padded(text.encode())
    listed = lambda tag, items: struct.pack(">ii", tag if items else 0, len(items)) + b"".join(items)
    axes = listed(10, [name(d) + struct.pack(">i", n) for d, n in zip(dims, data.shape, strict=True)])
    texts = listed(12, [name(k) + struct.pack(">ii", 2, len(v.encode())) + padded(v.encode()) for k, v in (attributes or {}).items()])
    first, second = padded(np.array(lead, ">f8").tobytes()), padded(data.astype(">f4").tobytes())

    def head(begin: int) -> bytes:
        one = name(dims[0]) + struct.pack(">ii", 1, 0) + listed(12, []) + struct.pack(">iiq", 6, len(first), begin)
        two = name(variable) + struct.pack(f">i{len(dims)}i", len(dims), *range(len(dims))) + texts + struct.pack(">iiq", 5, len(second), begin + len(first))
        return b"CDF\2" + struct.pack(">i", 0) + axes + listed(12, []) + listed(11, [one, two])

    return head(len(head(0))) + first + second


def write(table: DataFrame, folder: str, variable: str, dims: list[str]) -> None:
    """A file for each row of ``table`` (first, shape, values): its leading coordinate counts up from ``first``.  A file is named by it and written
    whole, so a task that runs twice leaves the same files."""
    ship(table.sparkSession)

    def run(batches):
        for b in batches:
            for first, shape, values in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                data = values.values.to_numpy(zero_copy_only=False).astype("f4").reshape(shape)
                put(f"{folder.rstrip('/')}/{first}.nc", encode(dims, [float(first + k) for k in range(shape[0])], variable, data))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    table.select("first", "shape", "values").mapInArrow(run, "n long").agg(F.sum("n")).collect()

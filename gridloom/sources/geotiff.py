"""Baseline TIFF and GeoTIFF rasters as tables of tiles, in two phases.

The first reads headers only and tells where each tile's bytes are (``extents``): a table that is filtered like any other.  The second deals the
tiles that are left over the tasks, and each reads its byte ranges (``read_tiles``); no file is whole in a task, and a large file is
read by many.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import ship
from gridloom.sources.codecs import UnsupportedCodec, lzw, packbits, unpredict
from gridloom.sources.ranged import Ranged, files, put

# Fixed values of the format: bytes and struct letters of the field types, and the tags read here.
FIELDS = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
PALETTE, TILE_W, TILE_H, TILES, TILE_BYTES, FORMAT, PIXEL_SCALE, TIEPOINT, NODATA = 320, 322, 323, 324, 325, 339, 33550, 33922, 42113


def _take(data, form: str, at: int) -> tuple:
    return struct.unpack(form, data[at : at + struct.calcsize(form)])


def directories(data) -> tuple[str, list[dict]]:
    """Byte order and the image directories (tag to values) of bytes or a file by ranges."""
    order = {b"II": "<", b"MM": ">"}.get(data[0:2])
    if order is None or _take(data, order + "H", 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, out = _take(data, order + "I", 4)[0], []
    while at:
        tags = {}
        n = _take(data, order + "H", at)[0]
        for k in range(n):
            tag, kind, count = _take(data, order + "HHI", at + 2 + 12 * k)
            if kind not in FIELDS:
                continue
            size, letter = FIELDS[kind]
            where = at + 10 + 12 * k if size * count <= 4 else _take(data, order + "I", at + 10 + 12 * k)[0]
            if tag == PALETTE:
                tags[tag] = [where, count]  # read where tiles are
            else:
                tags[tag] = data[where : where + count].rstrip(b"\0").decode("latin-1") if kind == 2 else list(_take(data, order + letter * count, where))
        out.append(tags)
        at = _take(data, order + "I", at + 2 + 12 * n)[0]
    return order, out


#: Tags that a tile's bytes are read by, under their names in a layout.
LAYOUT = {"compression": COMPRESSION, "bits": BITS, "format": FORMAT, "predictor": PREDICTOR}
EXTENTS = "path string, level int, plane int, y long, x long, height long, width long, offset long, length long, west double, north double, dx double, dy double, layout string"


def _place(tags: dict) -> tuple[float, float, float, float]:
    """west, north, dx, dy; pixel space where a file tells nothing."""
    dx, dy = tags.get(PIXEL_SCALE, [1.0, 1.0])[:2]
    tie = tags.get(TIEPOINT, [0.0] * 6)
    return tie[3] - tie[0] * dx, tie[4] + tie[1] * dy, dx, dy


def extents_of(data):
    """level, plane (null where bands are together), y, x, height, width, offset, length, west, north, dx, dy, layout of each tile or strip."""
    order, all_tags = directories(data)
    for level, tags in enumerate(all_tags):
        width, height, samples = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, [1])[0]
        planar, tiled = tags.get(PLANAR, [1])[0] == 2, TILES in tags
        tw, th = (tags[TILE_W][0], tags[TILE_H][0]) if tiled else (width, min(tags.get(ROWS, [height])[0], height))
        across, down = -(-width // tw), -(-height // th)
        layout = {name: tags[tag][0] for name, tag in LAYOUT.items() if tag in tags} | {"order": order, "samples": 1 if planar else samples}
        if tags.get(NODATA, "").strip():
            layout["nodata"] = float(tags[NODATA])
        if tags.get(PHOTOMETRIC, [1])[0] == 3 and PALETTE in tags:
            layout["palette"] = tags[PALETTE]
        offsets, sizes = tags[TILES if tiled else STRIPS], tags[TILE_BYTES if tiled else STRIP_BYTES]
        for k, (at, length) in enumerate(zip(offsets, sizes, strict=True)):
            plane, place = divmod(k, across * down)
            y, x = place // across * th, place % across * tw
            h, w = min(th, height - y), min(tw, width - x)
            stored = {"rows": th if tiled else h, "columns": tw}
            yield level, plane if planar else None, y, x, h, w, at, length, *_place(tags), json.dumps(layout | stored)


def _unpack(raw: bytes, lay: dict) -> np.ndarray:
    compression, order = lay.get("compression", 1), lay["order"]
    height, width, samples = lay["rows"], lay["columns"], lay["samples"]
    if compression == 5:
        raw = lzw(raw)
    elif compression in (8, 32946):
        raw = zlib.decompress(raw)
    elif compression == 32773:
        raw = packbits(raw)
    elif compression != 1:
        raise UnsupportedCodec(f"TIFF compression {compression}")
    bits, kind = lay.get("bits", 1), lay.get("format", 1)
    row = width * samples
    if bits in (1, 4, 12):
        bytes_ = np.frombuffer(raw, np.uint8)
        per = -(-row * bits // 8)
        line = np.unpackbits(bytes_[: per * height].reshape(height, per), axis=1)[:, : row * bits].reshape(height, row, bits)
        return (line * (1 << np.arange(bits - 1, -1, -1))).sum(axis=2).reshape(height, width, samples).astype(np.float64)
    dtype = np.dtype(f"{order}{'uif'[kind - 1] if kind in (1, 2, 3) else 'u'}{bits // 8}")
    out = np.frombuffer(raw, dtype, height * row).reshape(height, width, samples)
    predictor = lay.get("predictor", 1)
    return unpredict(out if predictor == 3 else out.astype(dtype.newbyteorder("=")), predictor).astype(np.float64)


def bands_of(data, plane: int | None, height: int, width: int, offset: int, length: int, lay: dict):
    """band and values of one tile; fill becomes NaN, palettes three bands."""
    block = _unpack(data[offset : offset + length], lay)[:height, :width]
    bands = [(plane, block[:, :, 0])] if plane is not None else [(s, block[:, :, s]) for s in range(block.shape[2])]
    if "palette" in lay:
        at, count = lay["palette"]
        table = np.frombuffer(data[at : at + 2 * count], lay["order"] + "u2").astype(float).reshape(3, -1) / 65535 * 255
        bands = [(c, table[c][bands[0][1].astype(int)]) for c in range(3)]
    for n, v in bands:
        if "nodata" in lay:
            v = np.where(np.abs(v - lay["nodata"]) <= max(1e-5 * abs(lay["nodata"]), 1e-6), np.nan, v)
        yield n, v


def extents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Where the bytes of every tile of every level are, from the headers alone."""
    types = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 6, *[pa.float64()] * 4, pa.string()]
    names = [c.split()[0] for c in EXTENTS.split(", ")]

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                with Ranged(path) as data:
                    rows = [(path, *r) for r in extents_of(data)]
                columns = list(zip(*rows, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    return files(spark, paths).mapInArrow(run, EXTENTS)


def read_tiles(found: DataFrame, tasks: int | None = None) -> DataFrame:
    """path, band, origin (y, x), shape, values and the file's place of the tiles of ``found``, a selection of ``extents``; dealt over ``tasks``."""
    tasks = tasks or int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["path", "band", "origin", "shape", "values", "west", "north", "dx", "dy"]
    types = [pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float32()), *[pa.float64()] * 4]
    order = ["path", "plane", "y", "x", "height", "width", "offset", "length", "layout", "west", "north", "dx", "dy"]

    def run(batches):
        data = opened = None
        for b in batches:
            for path, plane, y, x, h, w, at, length, layout, *place in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if path != opened:
                    if data is not None:
                        data.file.close()
                    data, opened = Ranged(path), path
                rows = [(path, n, [y, x], list(v.shape), v.ravel().astype("f4"), *place) for n, v in bands_of(data, plane, h, w, at, length, json.loads(layout))]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    dealt = found.repartition(tasks, "path", "offset").sortWithinPartitions("path", "offset")
    return dealt.select(*order).mapInArrow(run, "path string, band int, origin array<long>, shape array<long>, values array<float>, west double, north double, dx double, dy double")


def tiles(spark: SparkSession, paths: str | list[str], level: int = 0, band: int | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """path, band, origin (y, x), shape and values of the tiles; ``window`` (y0, y1, x0, x1) leaves out tiles that it does not touch."""
    found = extents(spark, paths).where(F.col("level") == level)
    if window is not None:
        y0, y1, x0, x1 = window
        found = found.where((F.col("y") < y1) & (F.col("y") + F.col("height") > y0) & (F.col("x") < x1) & (F.col("x") + F.col("width") > x0))
    if band is not None:
        found = found.where(F.col("plane").isNull() | (F.col("plane") == band))
    out = read_tiles(found).select("path", "band", "origin", "shape", "values")
    return out if band is None else out.where(F.col("band") == band)


def rasters(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, level, width, height, bands and geographic bounds (pixel space where there are none)."""

    def run(batches):
        for b in batches:
            rows = []
            for path in b.column(0).to_pylist():
                with Ranged(path) as data:
                    for level, t in enumerate(directories(data)[1]):
                        w, h = t[WIDTH][0], t[HEIGHT][0]
                        west, north, dx, dy = _place(t)
                        rows.append((path, level, w, h, 3 if t.get(PHOTOMETRIC, [1])[0] == 3 else t.get(SAMPLES, [1])[0], west, west + w * dx, north - h * dy, north))
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], ["path", "level", "width", "height", "bands", "west", "east", "south", "north"])

    return files(spark, paths).mapInArrow(run, "path string, level int, width long, height long, bands int, west double, east double, south double, north double")


def palettes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, code, and r, g, b (0 to 255) of the palettes of files, from the headers alone; for joins with codes."""

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                with Ranged(path) as data:
                    order, found = directories(data)
                    for tags in found[:1]:
                        if tags.get(PHOTOMETRIC, [1])[0] != 3 or PALETTE not in tags:
                            continue
                        at, count = tags[PALETTE]
                        table = np.frombuffer(data[at : at + 2 * count], order + "u2").astype(float).reshape(3, -1) / 65535 * 255
                        n = table.shape[1]
                        yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(range(n), pa.int32()), *map(pa.array, table)], ["path", "code", "r", "g", "b"])

    return files(spark, paths).mapInArrow(run, "path string, code int, r double, g double, b double")


def encode(data: np.ndarray, tile: int, west: float = 0.0, north: float = 0.0) -> bytes:
    """A tiled, deflated little-endian TIFF of one band of 32-bit floats, with its place."""
    h, w = data.shape
    body = bytearray(b"II*\0\0\0\0\0")
    offsets, sizes = [], []
    for y in range(0, h, tile):
        for x in range(0, w, tile):
            block = np.full((tile, tile), np.nan, "<f4")
            part = data[y : y + tile, x : x + tile]
            block[: part.shape[0], : part.shape[1]] = part
            raw = zlib.compress(block.tobytes())
            offsets.append(len(body))
            sizes.append(len(raw))
            body += raw + b"\0" * (len(raw) % 2)
    fields = {WIDTH: ("I", [w]), HEIGHT: ("I", [h]), BITS: ("H", [32]), COMPRESSION: ("H", [8]), PHOTOMETRIC: ("H", [1]), SAMPLES: ("H", [1]), TILE_W: ("I", [tile]), TILE_H: ("I", [tile])}
    fields |= {TILES: ("I", offsets), TILE_BYTES: ("I", sizes), FORMAT: ("H", [3]), PIXEL_SCALE: ("d", [1.0, 1.0, 0.0]), TIEPOINT: ("d", [0.0, 0.0, 0.0, west, north, 0.0])}
    number = {letter: kind for kind, (_, letter) in FIELDS.items()}
    start = len(body)
    late, entries = bytearray(), bytearray()
    for tag, (letter, values) in sorted(fields.items()):
        raw = struct.pack("<" + letter * len(values), *values)
        inline = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", start + 6 + 12 * len(fields) + len(late))
        late += b"" if len(raw) <= 4 else raw
        entries += struct.pack("<HHI", tag, number[letter], len(values)) + inline
    body[4:8] = struct.pack("<I", start)
    return bytes(body + struct.pack("<H", len(fields)) + entries + b"\0\0\0\0" + late)


def write(table: DataFrame, folder: str, tile: int = 64) -> None:
    """A file for each row of ``table`` (y0, x0, shape, values): the block's upper left corner is at west x0 and north -y0.  A file is named by its
    corner and written whole, so a task that runs twice leaves the same files."""
    ship(table.sparkSession)

    def run(batches):
        for b in batches:
            for y0, x0, shape, values in zip(*[b.column(k).to_pylist() for k in range(3)], b.column(3), strict=True):
                data = values.values.to_numpy(zero_copy_only=False).astype("f4").reshape(shape)
                put(f"{folder.rstrip('/')}/{y0}_{x0}.tif", encode(data, tile, float(x0), float(-y0)))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    table.select("y0", "x0", "shape", "values").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def composite_bands(table: DataFrame, keys: list[str]) -> DataFrame:
    """One row per cell with a column per band, from cells with a band column."""
    from gridloom.operators.select import bands_to_columns

    return bands_to_columns(table, "band", 3, keys).select(*keys, *[F.col(f"b{k}") for k in range(3)])

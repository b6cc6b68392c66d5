"""Stores written here and read back: Zarr 2 and 3, NetCDF classic, TIFF; and streams."""

import gzip
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators.select import Index, Range
from gridloom.sources import codecs, geotiff, netcdf3, store, zarr
from gridloom.streaming import windows


def write_zarr2(root, name, data, chunk, compressor, sep=".", attrs=None, skip=(), filters=None):
    folder = root / name
    folder.mkdir(parents=True)
    meta = {"zarr_format": 2, "shape": data.shape, "chunks": chunk, "dtype": data.dtype.str, "compressor": compressor and {"id": compressor}, "fill_value": 7, "order": "C", "filters": filters, "dimension_separator": sep}
    (folder / ".zarray").write_text(json.dumps(meta))
    (folder / ".zattrs").write_text(json.dumps(attrs or {}))
    for at in np.ndindex(*[-(-n // c) for n, c in zip(data.shape, chunk)]):
        if at in skip:
            continue
        block = np.full(chunk, 0, data.dtype)
        part = data[tuple(slice(p * c, (p + 1) * c) for p, c in zip(at, chunk))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        raw = block.tobytes()
        if filters:
            raw = np.frombuffer(raw, np.uint8).reshape(-1, data.dtype.itemsize).T.tobytes()
        raw = {None: lambda b: b, "gzip": gzip.compress, "zlib": zlib.compress}[compressor](raw)
        path = folder / sep.join(map(str, at))
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(raw)


def as_array(cells, dims, shape):
    out = np.full(shape, np.nan)
    for r in cells.collect():
        out[tuple(r[d] for d in dims)] = np.nan if r.v is None else r.v
    return out


@pytest.mark.parametrize("compressor,sep,filters", [(None, ".", None), ("gzip", "/", None), ("zlib", ".", [{"id": "shuffle", "elementsize": 2}])])
def test_zarr2(spark, tmp_path, compressor, sep, filters):
    data = np.arange(5 * 7, dtype="<i2").reshape(5, 7)
    write_zarr2(tmp_path / "s.zarr", "g/temp", data, (2, 3), compressor, sep, {"_ARRAY_DIMENSIONS": ["lat", "lon"], "scale_factor": 0.5, "add_offset": 1, "_FillValue": 8, "units": "K"}, skip={(1, 1)}, filters=filters)
    path = str(tmp_path / "s.zarr")
    v = store.open_variables(spark, path).first()
    assert (v.name, v.shape, v.dims, v.units, v.data_type) == ("g/temp", [5, 7], ["lat", "lon"], "K", "int16")
    table = zarr.chunks(spark, path, "g/temp")
    want = data.astype(float)
    want[2:4, 3:6] = 7  # the chunk without a file holds the fill value of the store
    want = np.where(want == 8, np.nan, want * 0.5 + 1)
    assert np.array_equal(as_array(zarr.cells(table, v.dims), v.dims, data.shape), want, equal_nan=True)
    some = zarr.chunks(spark, path, "g/temp", lat=Range(0, 2), lon=Index(1))
    assert some.count() == 1
    assert {(r.lat, r.lon) for r in zarr.cells(some, v.dims, lat=Range(0, 2), lon=Index(1)).collect()} == {(0, 1), (1, 1)}


def test_zarr3_and_inherited_attributes(spark, tmp_path):
    data = np.linspace(0, 1, 24).reshape(2, 3, 4).astype(">f8")
    folder = tmp_path / "v3.zarr" / "a" / "b"
    folder.mkdir(parents=True)
    (tmp_path / "v3.zarr" / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "group", "attributes": {"units": "top", "owner": "x"}}))
    (tmp_path / "v3.zarr" / "a" / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "group", "attributes": {"units": "m"}}))
    meta = {"zarr_format": 3, "node_type": "array", "shape": [2, 3, 4], "data_type": "float64", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [1, 3, 4]}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": "NaN", "codecs": [{"name": "bytes", "configuration": {"endian": "big"}}, {"name": "zstd", "configuration": {}}, {"name": "crc32c"}], "dimension_names": ["time", "y", "x"]}
    (folder / "zarr.json").write_text(json.dumps(meta))
    import zstandard

    for k in range(2):
        path = folder / "c" / str(k) / "0" / "0"
        path.parent.mkdir(parents=True)
        path.write_bytes(zstandard.ZstdCompressor().compress(data[k].tobytes()) + b"crc!")
    v = zarr.variables(spark, str(tmp_path / "v3.zarr")).first()
    assert (v.name, v.units, v.attributes["owner"]) == ("a/b", "m", "x")
    got = as_array(zarr.cells(zarr.chunks(spark, str(tmp_path / "v3.zarr"), "a/b"), v.dims), v.dims, (2, 3, 4))
    assert np.allclose(got, data, atol=1e-6)


def test_unknown_codec_is_an_error():
    with pytest.raises(codecs.UnsupportedCodec):
        codecs.decode(b"", [{"name": "pcodec"}], 4)
    with pytest.raises(store.UnsupportedStore):
        store.kind_of("table.csv")
    assert [store.kind_of(t) for t in ("s3://b/x.zarr?v=1", "a.nc", "b.TIF", "/data/x.zarr/group")] == ["zarr", "netcdf", "geotiff", "zarr"]


def netcdf_bytes():
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    name = lambda s: struct.pack(">i", len(s)) + pad(s.encode())
    text = lambda k, v: name(k) + struct.pack(">ii", 2, len(v)) + pad(v.encode())
    number = lambda k, kind, form, v: name(k) + struct.pack(">ii", kind, 1) + pad(struct.pack(form, v))
    dims = struct.pack(">ii", 10, 3) + b"".join(name(d) + struct.pack(">i", n) for d, n in (("time", 0), ("lat", 2), ("lon", 3)))
    t = np.arange(12, dtype=">i2").reshape(2, 2, 3)
    lat = np.array([45.0, -45.0], ">f8")
    attributes = struct.pack(">ii", 12, 4) + text("units", "degC") + number("scale_factor", 6, ">d", 0.1) + number("add_offset", 6, ">d", 10.0) + number("_FillValue", 3, ">h", 5)
    variable = lambda n, ids, atts, kind, size, begin: name(n) + struct.pack(">i", len(ids)) + struct.pack(f">{len(ids)}i", *ids) + atts + struct.pack(">iii", kind, size, begin)
    none = struct.pack(">ii", 0, 0)

    def head(b1, b2):
        return b"CDF\x01" + struct.pack(">i", 2) + dims + none + struct.pack(">ii", 11, 2) + variable("lat", [1], none, 6, 16, b1) + variable("temp", [0, 1, 2], attributes, 3, 12, b2)

    n = len(head(0, 0))
    return head(n, n + 16) + lat.tobytes() + t.tobytes(), t


def test_netcdf(spark, tmp_path):
    raw, t = netcdf_bytes()
    (tmp_path / "a.nc").write_bytes(raw)
    (tmp_path / "b.nc").write_bytes(raw)
    v = {r.name: r for r in netcdf3.variables(spark, str(tmp_path / "a.nc")).collect()}
    assert v["temp"].shape == [2, 2, 3] and v["temp"].dims == ["time", "lat", "lon"] and v["temp"].attributes["units"] == "degC"
    rows = netcdf3.chunks(spark, str(tmp_path), "temp")
    assert rows.count() == 4
    got = as_array(zarr.cells(rows.where(F.col("path").endswith("a.nc")), ["t", "y", "x"]), ["t", "y", "x"], (2, 2, 3))
    assert np.allclose(got, np.where(t == 5, np.nan, t * 0.1 + 10), atol=1e-5, equal_nan=True)
    assert [r.value for r in netcdf3.coordinates(spark, str(tmp_path / "a.nc"), "lat").orderBy("idx").collect()] == [45.0, -45.0]
    with pytest.raises(netcdf3.Unsupported):
        netcdf3.Header(b"\x89HDF\r\n")


def tiff_bytes(data, tile=None, compression=1, predictor=1, extra=()):
    """A small-endian TIFF of (height, width, samples)."""
    h, w, s = data.shape
    th, tw = tile or (h, w)
    blocks = []
    for y in range(0, h, th):
        for x in range(0, w, tw):
            b = np.zeros((th, tw, s), data.dtype)
            part = data[y : y + th, x : x + tw]
            b[: part.shape[0], : part.shape[1]] = part
            if predictor == 2:
                b = np.concatenate([b[:, :1], np.diff(b, axis=1)], axis=1)
            raw = b.astype(data.dtype).tobytes()
            blocks.append({1: raw, 8: zlib.compress(raw) if compression == 8 else raw, 32773: b"".join(bytes([len(raw[k : k + 128]) - 1]) + raw[k : k + 128] for k in range(0, len(raw), 128))}[compression])
    body, offsets = b"II*\0\0\0\0\0", []
    for b in blocks:
        offsets.append(len(body))
        body += b
    kind = {"u": 1, "i": 2, "f": 3}[data.dtype.kind]
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [data.dtype.itemsize * 8] * s), (259, 3, [compression]), (262, 3, [1]), (277, 3, [s]), (317, 3, [predictor]), (339, 3, [kind] * s)]
    tags += [(322, 4, [tw]), (323, 4, [th]), (324, 4, offsets), (325, 4, [len(b) for b in blocks])] if tile else [(273, 4, offsets), (278, 4, [h]), (279, 4, [len(b) for b in blocks])]
    tags = sorted([*tags, *extra])
    late, entries = b"", b""
    start = len(body) + 2 + 12 * len(tags) + 4
    for tag, t, v in tags:
        raw = v.encode() + b"\0" if t == 2 else struct.pack("<" + {3: "H", 4: "I", 12: "d"}[t] * len(v), *v)
        n = len(raw) if t == 2 else len(v)
        if len(raw) <= 4:
            entries += struct.pack("<HHI", tag, t, n) + raw.ljust(4, b"\0")
        else:
            entries += struct.pack("<HHII", tag, t, n, start + len(late))
            late += raw
    return body[:4] + struct.pack("<I", len(body)) + body[8:] + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + late


@pytest.mark.parametrize("dtype,tile,compression,predictor", [("u1", None, 1, 1), ("<i2", (16, 16), 8, 2), ("<f4", (16, 16), 1, 1), ("u1", (16, 16), 32773, 1)])
def test_tiff(spark, tmp_path, dtype, tile, compression, predictor):
    data = (np.arange(20 * 24 * 3).reshape(20, 24, 3) % 120).astype(dtype)
    extra = [(33550, 12, [0.5, 0.25, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 10.0, 50.0, 0.0]), (42113, 2, "7")]
    path = tmp_path / "a.tif"
    path.write_bytes(tiff_bytes(data, tile, compression, predictor, extra))
    r = geotiff.rasters(spark, str(path)).first()
    assert (r.width, r.height, r.bands, r.west, r.east, r.south, r.north) == (24, 20, 3, 10.0, 22.0, 45.0, 50.0)
    want = np.where(data == 7, np.nan, data.astype(float))
    for band in range(3):
        t = geotiff.tiles(spark, str(path), band=band)
        assert np.array_equal(as_array(zarr.cells(t, ["y", "x"]), ["y", "x"], (20, 24)), want[:, :, band], equal_nan=True)
    if tile:
        assert geotiff.tiles(spark, str(path), band=0, window=(0, 4, 0, 4)).count() == 1


def test_lzw_and_predictors():
    def compress(data):
        table, out, width, acc, bits, word = {bytes([k]): k for k in range(256)}, bytearray(), 9, 0, 0, b""
        codes = [(256, 9)]
        size = 258
        for c in data:
            nxt = word + bytes([c])
            if nxt in table:
                word = nxt
                continue
            codes.append((table[word], width))
            table[nxt] = size
            size += 1
            if size + 1 > 1 << width and width < 12:
                width += 1
            word = bytes([c])
        codes.append((table[word], width))
        size += 1
        if size + 1 > 1 << width and width < 12:
            width += 1
        codes.append((257, width))
        for code, n in codes:
            acc, bits = (acc << n) | code, bits + n
            while bits >= 8:
                bits -= 8
                out.append((acc >> bits) & 255)
        if bits:
            out.append((acc << (8 - bits)) & 255)
        return bytes(out)

    data = bytes(np.random.default_rng(0).integers(0, 6, 3000, dtype=np.uint8))
    assert codecs.lzw(compress(data)) == data
    assert codecs.packbits(b"\x02abc\xfed") == b"abcddd"
    assert codecs.unpredict(np.array([[[10], [5], [2]]], np.uint8), 2).ravel().tolist() == [10, 15, 17]
    x = np.array([[[1.5], [-2.0], [1e10]]], ">f4")
    planes = np.frombuffer(x.tobytes(), np.uint8).reshape(3, 4).T.ravel()
    coded = np.concatenate([planes[:1], np.diff(planes)]).astype(np.uint8)
    assert codecs.unpredict(coded.view("<f4").reshape(1, 3, 1), 3).ravel().tolist() == [1.5, -2.0, 1e10]


def run_memory(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append" if name != "tumble" else "update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 400).parquet(str(tmp_path / "in"))
    stream = lambda: windows.read_events(spark, str(tmp_path / "in"), events.schema, 10)
    got = run_memory(windows.tumbling(stream()), "tumble")
    assert got.agg(F.sum("n")).first()[0] == 1000
    assert run_memory(windows.distinct_events(stream(), "event_id"), "dedup").count() == 1000
    windows.upsert_chunks(stream(), str(tmp_path / "out"), str(tmp_path / "cp"), "event_id", 100).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 1000 and out.select("chunk").distinct().count() == 10

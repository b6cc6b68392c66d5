"""Scans that plan their reads: chunks by number, tiles and steps by byte ranges, stores by one document."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

from gridloom.operators.select import Index, Range
from gridloom.sources import codecs as codecs_of
from gridloom.sources import datasource, geotiff, netcdf3, ranged, zarr
from tests.test_sources import as_array, netcdf_bytes, tiff_bytes, write_zarr2


def big_store(tmp_path, written=()):
    """A store of 100,000 chunks, of which some have files."""
    root = tmp_path / "big.zarr"
    array = root / "a"
    array.mkdir(parents=True)
    (array / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [1000, 4000], "chunks": [10, 4], "dtype": "<f4", "fill_value": -1.0, "order": "C", "filters": None, "compressor": None}))
    (array / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": ["y", "x"]}))
    for y, x in written:
        (array / f"{y}.{x}").write_bytes(np.full((10, 4), y * 1000 + x, "<f4").tobytes())
    return str(root)


def opened(reader, monkeypatch):
    """Chunk files that a reader opens for all its partitions."""
    seen = []
    monkeypatch.setattr(zarr.Layout, "content", lambda self, folder, place, *_: seen.append(self.key(place)))
    for p in reader.partitions():
        list(reader.read(p))
    return seen


def reader_of(store, filters, **options):
    r = datasource.ChunkReader(store, zarr.open_array(store, "a"), options)
    assert list(r.pushFilters(filters)) == filters  # Spark looks at the rows again
    return r


@pytest.mark.parametrize(
    "filters,rows,columns",
    [
        ([GreaterThanOrEqual(("y",), 15), LessThan(("y",), 31), EqualTo(("x",), 9)], (1, 3), (2, 2)),
        ([GreaterThan(("y",), 19), LessThanOrEqual(("y",), 20), In(("x",), (3, 8))], (2, 2), (0, 2)),
        ([EqualTo(("y",), 999), GreaterThan(("x",), 3995)], (99, 99), (999, 999)),
    ],
)
def test_pushed_filters_plan_the_chunks(tmp_path, monkeypatch, filters, rows, columns):
    store = big_store(tmp_path)
    want = [f"{y}.{x}" for y in range(rows[0], rows[1] + 1) for x in range(columns[0], columns[1] + 1)]
    assert opened(reader_of(store, filters), monkeypatch) == want


def test_partitions_are_computed(tmp_path, monkeypatch):
    store = big_store(tmp_path)
    monkeypatch.setattr("os.listdir", None)
    monkeypatch.setattr("os.scandir", None)
    r = reader_of(store, [], bytes="3200")
    parts = r.partitions()
    assert len(parts) == 10000 and (parts[0].first, parts[-1].last) == (0, 100000) and all(p.last - p.first == 10 for p in parts)
    assert opened(reader_of(store, [EqualTo(("y",), 5), GreaterThan(("y",), 40)]), monkeypatch) == []
    assert opened(reader_of(store, [EqualTo(("c_y",), 5), LessThan(("c_x",), 2)], rows="chunks"), monkeypatch) == ["5.0", "5.1"]


def test_scan_of_a_large_store(spark, tmp_path):
    store = big_store(tmp_path, [(50, 500), (50, 501)])
    cells = datasource.scan(spark, store, "a").where("y = 503 AND x >= 1998 AND x < 2010")
    got = {(r.y, r.x): r.v for r in cells.collect()}
    assert got == {(503, x): -1.0 if x < 2000 or x >= 2008 else 50500.0 + (x - 2000) // 4 for x in range(1998, 2010)}
    assert cells.rdd.getNumPartitions() == 1
    assert datasource.scan(spark, store, "a").where("y = 5 AND y = 700").count() == 0


def test_three_kinds_of_documents(spark, tmp_path):
    data = np.arange(12, dtype="<f4").reshape(3, 4)
    write_zarr2(tmp_path, "two", data, (2, 2), None, attrs={"_ARRAY_DIMENSIONS": ["p", "q"]})
    (tmp_path / "three" / "c" / "0").mkdir(parents=True)
    (tmp_path / "three" / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "array", "shape": [3, 4], "data_type": "float32", "dimension_names": ["p", "q"], "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [3, 4]}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": 0, "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}], "attributes": {}}))
    (tmp_path / "three" / "c" / "0" / "0").write_bytes(data.tobytes())
    (tmp_path / "meta" / "root").mkdir(parents=True)
    (tmp_path / "meta" / "root" / "early.array.json").write_text(json.dumps({"shape": [3, 4], "data_type": "<f4", "chunk_grid": {"type": "regular", "chunk_shape": [3, 4], "separator": "/"}, "chunk_memory_layout": "C", "fill_value": 7, "attributes": {"_ARRAY_DIMENSIONS": ["p", "q"]}}))
    for name in ("two", "three"):
        assert (as_array(datasource.scan(spark, str(tmp_path), name), ["p", "q"], (3, 4)) == data).all()
    assert (as_array(datasource.scan(spark, str(tmp_path), "/early/"), ["p", "q"], (3, 4)) == 7).all()  # no chunks there
    with pytest.raises(KeyError):
        zarr.open_array(str(tmp_path), "none")


@pytest.mark.parametrize("version", [2, 3])
def test_one_document_tells_a_thousand_arrays(spark, tmp_path, monkeypatch, version):
    documents = {}
    for k in range(1000):
        path = f"g{k % 10}/a{k}"
        if version == 2:
            documents[f"{path}/.zarray"] = {"zarr_format": 2, "shape": [k + 1], "chunks": [10], "dtype": "<i2", "fill_value": 0, "order": "C", "filters": None, "compressor": None}
            documents[f"{path}/.zattrs"] = {"units": "own"} if k % 3 == 0 else {}
        else:
            documents[f"{path}/zarr.json"] = {"zarr_format": 3, "node_type": "array", "shape": [k + 1], "data_type": "int16", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [10]}}, "chunk_key_encoding": {"name": "default"}, "fill_value": 0, "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}], "attributes": {"units": "own"} if k % 3 == 0 else {}}
    for g in range(10):
        documents[f"g{g}/.zattrs" if version == 2 else f"g{g}/zarr.json"] = {"units": f"of g{g}"} if version == 2 else {"zarr_format": 3, "node_type": "group", "attributes": {"units": f"of g{g}"}}
    zarr.consolidate(spark, str(tmp_path), documents, version)
    reads = []
    read = ranged.read_whole
    monkeypatch.setattr(zarr, "read_whole", lambda a: (raw := read(a), raw is not None and reads.append(a))[0])
    rows = {r.name: r for r in zarr.variables(spark, str(tmp_path)).collect()}
    assert len(rows) == 1000 and len(reads) == 1
    assert all(rows[f"g{k % 10}/a{k}"].shape == [k + 1] and rows[f"g{k % 10}/a{k}"].units == ("own" if k % 3 == 0 else f"of g{k % 10}") for k in range(1000))
    assert zarr.open_array(str(tmp_path), "g7/a17")[2] == [18] and len(reads) == 2


def test_tiff_reads_ranges(spark, tmp_path):
    data = np.random.default_rng(2).integers(0, 250, size=(2048, 1024, 1)).astype("u1")
    path = str(tmp_path / "a.tif")
    (tmp_path / "a.tif").write_bytes(tiff_bytes(data, (64, 64)))
    with ranged.Ranged(path) as f:
        found = list(geotiff.extents_of(f))
        assert len(found) == 512 and f.fetched < len(f) / 10  # tiles are left where they are
    tiles = geotiff.tiles(spark, path, window=(100, 900, 30, 700))
    assert tiles.rdd.getNumPartitions() > 1
    parts = tiles.select(F.spark_partition_id().alias("p"), "origin").distinct().groupBy("p").count().collect()
    assert len(parts) > 1 and sum(r["count"] for r in parts) == 14 * 11  # one file, several tasks
    box = {"y": Range(100, 900), "x": Range(30, 700)}
    got = zarr.cells(tiles, ["y", "x"], **box).agg(F.count("*"), F.sum(F.col("v") * (F.col("y") * 7 + F.col("x")))).first()
    y, x = np.indices((2048, 1024))
    assert tuple(got) == (800 * 670, float((data[:, :, 0].astype(float) * (y * 7 + x))[100:900, 30:700].sum()))


def test_tiff_written_and_read(spark, tmp_path):
    data = np.random.default_rng(3).normal(size=(50, 37)).astype("f4")
    data[3, 4] = np.nan
    t = spark.createDataFrame([(100, 7, [50, 37], data.ravel().astype(float).tolist())], "y0 long, x0 long, shape array<long>, values array<double>")
    geotiff.write(t, str(tmp_path / "out"), tile=16)
    r = geotiff.rasters(spark, str(tmp_path / "out")).first()
    assert (r.width, r.height, r.west, r.north, r.south) == (37, 50, 7.0, -100.0, -150.0)
    assert np.array_equal(as_array(zarr.cells(geotiff.tiles(spark, str(tmp_path / "out")), ["y", "x"]), ["y", "x"], (50, 37)), data.astype(float), equal_nan=True)


def test_netcdf_reads_ranges(spark, tmp_path, monkeypatch):
    data = np.random.default_rng(4).normal(size=(40, 60, 50)).astype("f4")
    raw = netcdf3.encode(["t", "y", "x"], [10.0 + k for k in range(40)], "v", data, {"units": "K"})
    (tmp_path / "a.nc").write_bytes(raw)
    path = str(tmp_path / "a.nc")
    monkeypatch.setattr(netcdf3, "EXTENT_BYTES", 2000)
    with ranged.Ranged(path) as f:
        found = list(netcdf3.extents_of(netcdf3.Header(f), "v", {"t": Range(3, 9), "y": Range(10, 25), "x": Index(7)}))
        assert f.fetched < len(f) / 2
    assert sum(r[3] for r in found) == 6 * 15 * 50 * 4 and len(found) == 6 * 2 and {r[4] for r in found} == {13.0 + k for k in range(6)}
    chunks = netcdf3.chunks(spark, path, "v", t=Range(3, 9), y=Range(10, 25), x=Range(7, 11))
    got = {(r.t, r.y, r.x): r.v for r in zarr.cells(chunks, ["t", "y", "x"]).collect()}
    assert got == {(t, y, x): float(data[t, y, x]) for t in range(3, 9) for y in range(10, 25) for x in range(7, 11)}
    assert chunks.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert [r.value for r in netcdf3.coordinates(spark, path, "t").orderBy("idx").collect()] == [10.0 + k for k in range(40)]
    line = zarr.cells(netcdf3.chunks(spark, path, "t", steps=Range(5, 9)), ["t"])
    assert {(r.t, r.v) for r in line.collect()} == {(k, 10.0 + k) for k in range(5, 9)}


def test_netcdf_with_record_variables(spark, tmp_path):
    raw, t = netcdf_bytes()
    (tmp_path / "r.nc").write_bytes(raw)
    got = as_array(zarr.cells(netcdf3.chunks(spark, str(tmp_path / "r.nc"), "temp", lat=Index(1)), ["t", "y", "x"]), ["t", "y", "x"], (2, 2, 3))[:, 1]
    assert np.allclose(got, np.where(t == 5, np.nan, t * 0.1 + 10)[:, 1], atol=1e-5, equal_nan=True)


def test_damaged_headers_raise():
    for raw in (b"", b"CD", b"\x89HDF\r\n\x1a\n", b"CDF\x07" + b"\0" * 8):
        with pytest.raises(netcdf3.Unsupported):
            netcdf3.Header(raw)
    for raw in (b"", b"XX*\0", b"II+\0"):
        with pytest.raises((ValueError, struct.error)):
            geotiff.directories(raw)


def sharded(tmp_path, data, shard, inner, codecs, at="end", skip=(), turn=None):
    """A store of version 3 with one array ``a`` in shards, written by the format's description."""
    folder = tmp_path / "s.zarr" / "a"
    chain = [{"name": "transpose", "configuration": {"order": turn}}] if turn else []
    chain += [{"name": "bytes", "configuration": {"endian": "little"}}, *codecs]
    how = {"chunk_shape": inner, "codecs": chain, "index_codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}], "index_location": at}
    meta = {"zarr_format": 3, "node_type": "array", "shape": data.shape, "data_type": data.dtype.name, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": shard}}, "chunk_key_encoding": {"name": "default"}, "fill_value": -5, "codecs": [{"name": "sharding_indexed", "configuration": how}], "dimension_names": ["y", "x"]}
    folder.mkdir(parents=True)
    (folder / "zarr.json").write_text(json.dumps(meta))
    counts = [n // c for n, c in zip(shard, inner)]
    for place in np.ndindex(*[-(-n // c) for n, c in zip(data.shape, shard)]):
        index, body = b"", b""
        first = 16 * counts[0] * counts[1] + 4 if at == "start" else 0
        for k in np.ndindex(*counts):
            low = [p * s + i * c for p, s, i, c in zip(place, shard, k, inner)]
            if (place, k) in skip or low[0] >= data.shape[0] or low[1] >= data.shape[1]:
                index += struct.pack("<QQ", 2**64 - 1, 2**64 - 1)
                continue
            block = np.zeros(inner, data.dtype)
            part = data[low[0] : low[0] + inner[0], low[1] : low[1] + inner[1]]
            block[: part.shape[0], : part.shape[1]] = part
            piece = codecs_of.encode((block.transpose(turn) if turn else block).tobytes(), codecs, data.dtype.itemsize)
            index += struct.pack("<QQ", first + len(body), len(piece))
            body += piece
        index += codecs_of.crc32c(index).to_bytes(4, "little")
        path = folder / "c" / str(place[0]) / str(place[1])
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(index + body if at == "start" else body + index)
    return str(tmp_path / "s.zarr")


@pytest.mark.parametrize("at,turn,names", [("end", None, []), ("start", None, ["zstd", "crc32c"]), ("end", [1, 0], ["blosc"])])
def test_shards(spark, tmp_path, at, turn, names):
    data = np.arange(22 * 13, dtype="<i4").reshape(22, 13)
    store = sharded(tmp_path, data, [8, 6], [2, 3], [{"name": n} for n in names], at, skip={((0, 0), (1, 1))}, turn=turn)
    (tmp_path / "s.zarr" / "a" / "c" / "2" / "0").unlink()  # a shard that is not there
    want = data.astype(float)
    want[2:4, 3:6] = want[16:, :6] = -5
    assert np.array_equal(as_array(datasource.scan(spark, store, "a", verify=True), ["y", "x"], data.shape), want)
    some = datasource.scan(spark, store, "a").where("y >= 5 AND y < 11 AND x IN (2, 12)")
    assert {(r.y, r.x): r.v for r in some.collect()} == {(y, x): want[y, x] for y in range(5, 11) for x in (2, 12)}


def test_a_shard_is_read_by_ranges(tmp_path, monkeypatch):
    data = np.arange(64 * 64, dtype="<i4").reshape(64, 64)
    store = sharded(tmp_path, data, [32, 64], [4, 4], [])
    reader = reader_of(store, [EqualTo(("y",), 33), LessThan(("x",), 8)])
    seen, plain = [], ranged.read_range
    monkeypatch.setattr(zarr, "read_range", lambda *a: seen.append(a[2]) or plain(*a))
    rows = [b.num_rows for p in reader.partitions() for b in reader.read(p)]
    # One index (128 chunks) for both chunks, and their own bytes.
    assert rows == [16, 16] and seen == [128 * 16 + 4, 64, 64]


def test_damaged_and_unknown_shards(tmp_path):
    store = sharded(tmp_path, np.zeros((4, 4), "<i4"), [4, 4], [2, 2], [])
    file = tmp_path / "s.zarr" / "a" / "c" / "0" / "0"
    raw = bytearray(file.read_bytes())
    raw[-9] ^= 1
    file.write_bytes(raw)
    reader = reader_of(store, [], verify="true")
    with pytest.raises(codecs_of.DamagedChunk):
        list(reader.read(reader.partitions()[0]))
    file.write_bytes(b"abc")
    reader = reader_of(store, [])
    with pytest.raises(codecs_of.DamagedChunk):
        list(reader.read(reader.partitions()[0]))
    path = tmp_path / "s.zarr" / "a" / "zarr.json"
    meta = json.loads(path.read_text())
    meta["codecs"].append({"name": "gzip"})
    path.write_text(json.dumps(meta))
    with pytest.raises(codecs_of.UnsupportedCodec):
        zarr.open_array(store, "a")


def test_shards_written(spark, tmp_path):
    data = np.random.default_rng(3).integers(-9, 9, (21, 12)).astype("f4")
    rows = [(y, 0, [min(8, 21 - y * 8), 12], data[y * 8 : y * 8 + 8].ravel().tolist()) for y in range(3)]
    table = spark.createDataFrame(rows, "c_y long, c_x long, shape array<long>, values array<float>")
    blosc = {"name": "blosc", "configuration": {"cname": "zlib", "shuffle": "bitshuffle"}}
    zarr.write(table, str(tmp_path / "w.zarr"), "m", ["y", "x"], [21, 12], [8, 12], codecs=[blosc], inner=[4, 6])
    assert np.array_equal(as_array(datasource.scan(spark, str(tmp_path / "w.zarr"), "m", verify=True), ["y", "x"], data.shape), data)
    with pytest.raises(ValueError):
        zarr.write(table, str(tmp_path / "v.zarr"), "m", ["y", "x"], [21, 12], [8, 12], inner=[3, 6])

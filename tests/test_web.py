"""Stores that a web server holds, read by requests for ranges."""

import http.server
import threading

import numpy as np
import pytest

from gridloom.operators.select import Range
from gridloom.sources import datasource, geotiff, ranged, store, zarr
from tests.test_scans import sharded
from tests.test_sources import as_array, tiff_bytes, write_zarr2


class Server(http.server.BaseHTTPRequestHandler):
    root, seen, ranges, failures, lengths = None, [], True, 0, True

    def log_message(self, *_):
        pass

    def do_HEAD(self):
        self.answer(False)

    def do_GET(self):
        self.answer(True)

    def answer(self, send):
        cls, asked = type(self), self.headers.get("Range")
        cls.seen.append((self.command, self.path, asked))
        file = cls.root / self.path.lstrip("/").replace("%20", " ")
        if cls.failures:
            cls.failures -= 1
            return self.send_error(503)
        if not file.is_file():
            return self.send_error(404)
        body, status, total = file.read_bytes(), 200, file.stat().st_size
        if asked and cls.ranges:
            first, last = map(int, asked.removeprefix("bytes=").split("-"))
            body, status = body[first : last + 1], 206
        self.send_response(status)
        if status == 206:
            self.send_header("Content-Range", f"bytes {asked.removeprefix('bytes=')}/{total}")
        if send or cls.lengths:
            self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        if send:
            self.wfile.write(body)


@pytest.fixture
def web(tmp_path):
    handler = type("Here", (Server,), {"root": tmp_path, "seen": []})
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield handler, f"http://127.0.0.1:{server.server_port}"
    server.shutdown()
    server.server_close()


def test_store_on_the_web(spark, tmp_path, web):
    handler, address = web
    data = np.arange(5 * 7, dtype="<i2").reshape(5, 7)
    write_zarr2(tmp_path / "s.zarr", "air temp", data, (2, 3), "zlib", attrs={"_ARRAY_DIMENSIONS": ["lat", "lon"], "units": "K"}, skip={(1, 1)})
    want = data.astype(float)
    want[2:4, 3:6] = 7
    table = zarr.chunks(spark, f"{address}/s.zarr", "air temp")
    assert np.array_equal(as_array(zarr.cells(table, ["lat", "lon"]), ["lat", "lon"], data.shape), want)
    handler.seen.clear()
    cells = store.open_cells(spark, f"{address}/s.zarr", "air temp", lat=Range(0, 2), lon=Range(6, 7))
    assert {(r.lat, r.lon): r.v for r in cells.collect()} == {(0, 6): 6, (1, 6): 13}
    # One chunk; the rest of what was asked for is metadata.
    assert {p.rpartition("/")[2] for _, p, _ in handler.seen if "." not in p.rpartition("/")[2][:1] and not p.endswith(".json")} == {"0.2"}
    with pytest.raises(FileNotFoundError):
        zarr.variables(spark, f"{address}/s.zarr")
    zarr.consolidate(spark, str(tmp_path / "s.zarr"), {"air temp/.zarray": {"zarr_format": 2, "shape": [5, 7], "chunks": [2, 3], "dtype": "<i2", "fill_value": 7, "compressor": {"id": "zlib"}}, "air temp/.zattrs": {"units": "K"}}, version=2)
    assert [(r.name, r.units) for r in zarr.variables(spark, f"{address}/s.zarr").collect()] == [("air temp", "K")]
    assert store.kind_of(f"{address}/s.zarr?x=1") == "zarr"


def test_shards_on_the_web(spark, tmp_path, web):
    handler, address = web
    data = np.arange(22 * 13, dtype="<i4").reshape(22, 13)
    sharded(tmp_path, data, [8, 6], [2, 3], [{"name": "zstd"}])
    cells = datasource.scan(spark, f"{address}/s.zarr", "a", verify=True).where("y = 9 AND x = 4")
    assert [r.v for r in cells.collect()] == [data[9, 4]]
    got = [s for s in handler.seen if s[1].endswith("c/1/0")]
    assert got[0][0] == "HEAD" and len(got) == 3 and all(r for m, _, r in got[1:])


@pytest.mark.parametrize("ranges", [True, False])
@pytest.mark.parametrize("lengths", [True, False])
def test_ranges(tmp_path, web, ranges, lengths):
    handler, address = web
    handler.ranges, handler.lengths = ranges, lengths or not ranges
    (tmp_path / "f.bin").write_bytes(bytes(range(200)))
    there = f"{address}/f.bin"
    assert ranged.read_range(there, 10, 5) == bytes(range(10, 15)) and ranged.read_range(there, 10, 0) == b""
    assert ranged.length(there) == 200 and ranged.length(f"{address}/none") is None and ranged.read_whole(f"{address}/none") is None
    with ranged.Ranged(there) as data:
        assert len(data) == 200 and data[190:300] == bytes(range(190, 200)) and data[300:] == b""


def test_failures_are_tried_again(tmp_path, web, monkeypatch):
    handler, address = web
    monkeypatch.setattr(ranged.time, "sleep", lambda _: None)
    (tmp_path / "f.bin").write_bytes(b"abc")
    handler.failures = ranged.TRIES - 1
    assert ranged.read_whole(f"{address}/f.bin") == b"abc"
    handler.failures = ranged.TRIES
    with pytest.raises(OSError):
        ranged.read_whole(f"{address}/f.bin")


def test_kinds_of_folders_on_the_web(tmp_path, web):
    _, address = web
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / ".zgroup").write_text("{}")
    assert store.kind_of(f"{address}/plain") == "zarr"
    with pytest.raises(store.UnsupportedStore):
        store.kind_of(f"{address}/nothing")


def test_raster_on_the_web(spark, tmp_path, web):
    _, address = web
    data = np.arange(40 * 36, dtype="<u2").reshape(40, 36)
    (tmp_path / "r.tif").write_bytes(tiff_bytes(data[:, :, None], (16, 16)))
    got = geotiff.extents(spark, f"{address}/r.tif")
    assert got.count() == 9
    table = geotiff.read_tiles(got)
    assert np.array_equal(as_array(zarr.cells(table, ["y", "x"]), ["y", "x"], data.shape), data)

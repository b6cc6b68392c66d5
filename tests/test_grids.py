"""Edges of grids, DGGS metadata, store addresses and residency that the given tables do not hold."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import healpix
from gridloom.operators import catalog, coords, grids
from gridloom.operators.select import Index, Range
from gridloom.sources import codecs, netcdf3, remote, zarr
from tests.test_sources import as_array, netcdf_bytes

ATTRIBUTES = "k int, a map<string,string>"


def test_dggs_of_hostile_attributes(spark):
    rows = [(0, {}), (1, None), (2, {"dggs": "{not json"}), (3, {"dggs": '{"refinement_level": 3}'}), (4, {"dggs": '{"name": "H3", "refinement_level": 40}'}), (5, {"grid_name": "HEALPIX", "healpix_level": "x7"}), (6, {"dggs": "HealPix", "healpix_nest": "true"})]
    t = spark.createDataFrame(rows, ATTRIBUTES).withColumn("m", grids.dggs(F.col("a")))
    got = {r.k: r for r in t.select("k", "m.*", grids.is_healpix(F.col("m")).alias("hp"), grids.nside(F.col("m"), F.lit(48).cast("long")).alias("nside"), grids.ordering(F.col("a"), F.col("m")).alias("o")).collect()}
    assert [got[k].name for k in range(7)] == [None, None, None, None, "H3", "healpix", "healpix"]
    assert [got[k].hp for k in range(7)] == [False] * 5 + [True] * 2
    assert got[4].nside == 2 and got[5].nside == 2 and got[5].refinement_level is None  # by the number of pixels
    assert got[6].o == "ring"  # metadata count before single attributes


def test_grids_of_short_and_missing_axes(spark):
    rows = [("one", "x", "lon", 1, 0, 5.0), ("one", "y", "lat", 1, 0, 6.0), ("odd", "x", "cell", 50, 0, None), ("odd", "y", "z", 1, 0, None)]
    t = spark.createDataFrame(rows, "g string, axis string, dim string, size long, idx int, value double")
    got = {r.g: r for r in grids.detect(t, "g").collect()}
    assert (got["one"].kind, got["one"].west, got["one"].east, got["one"].north) == ("regional", 5.0, 5.0, 6.0)
    assert (got["odd"].kind, got["odd"].nside) == ("global", None)  # 50 is not 12 times a square
    assert grids.detect(t.where("false"), "g").count() == 0


def test_corners_without_finite_pixels_keep_the_pixel(spark):
    cells = spark.createDataFrame([(0, math.nan), (1, 4.0), (2, None), (3, 1e31), (12, 7.0)], "pix long, v double")
    got = {(r.pix, r.corner_x, r.corner_y): r.v for r in grids.corner_means(cells, 4).collect()}
    assert len(got) == 20 and got[0, 1, 1] == 4.0 and math.isnan(got[0, 0, 0]) and got[3, 1, 1] == 7.0 and got[2, 0, 1] is None
    # Pixel 12 stands next to the corner of pixel 3 on the same face.
    assert got[12, 0, 0] == 7.0


def test_addresses(spark):
    urls = ["", "  ", None, "s3://", "vcc://c/a//b/", "https://", "https://data.source.coop/", "https://data.source.coop/x", "icechunk+s3://b/k", "host.org"]
    got = spark.createDataFrame(list(enumerate(urls)), "k int, u string").select("k", remote.parse(F.col("u")).alias("p")).orderBy("k").collect()
    assert [r.p and (r.p.bucket, r.p.prefix) for r in got] == [None, None, None, None, ("c", "a/b"), None, None, ("x", None), ("b", "k"), ("host.org", None)]
    assert got[9].p.endpoint == "https://host.org" and got[9].p.path_style


@pytest.mark.parametrize("bins", [1, 2, 7, 256])
def test_survivors_with_ties_and_hot_spans(spark, bins):
    rng = np.random.default_rng(3)
    rows = [(f"s{k % 2}", int(k), int(rng.choice([5, 5, 5, 9, int(rng.integers(0, 50))])), int(rng.integers(0, 9))) for k in range(400)]
    t = spark.createDataFrame(rows, "source string, block long, last_access long, bytes long")
    got = {(r.source, r.block): r.held for r in catalog.lru_survivors(t, 300, "source", bins=bins).collect()}
    want = {}
    for s in ("s0", "s1"):
        held = 0
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: (-r[2], -r[1])):
            held += r[3]
            if held <= 300:
                want[s, r[1]] = held
    assert got == want
    assert catalog.lru_survivors(t.where("false"), 300, "source", bins=bins).count() == 0


def test_nearest_on_axes_of_one_and_two_places(spark):
    points = spark.createDataFrame([(-1.0,), (0.0,), (2.0,), (9.0,)], "p double")
    one = spark.createDataFrame([(0, 3.0)], "idx long, value double")
    two = spark.createDataFrame([(0, 0.0), (1, 4.0)], "idx long, value double")
    assert {r.p: r.idx for r in coords.nearest(points, "p", one).collect()} == {-1.0: 0, 0.0: 0, 2.0: 0, 9.0: 0}
    assert {r.p: r.idx for r in coords.nearest(points, "p", two).collect()} == {-1.0: 0, 0.0: 0, 2.0: 0, 9.0: 1}
    assert "SinglePartition" not in coords.nearest(points, "p", two)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("version,data_type,chain", [(3, "<f4", []), (3, ">f8", ["gzip"]), (3, "<f8", ["zstd", "crc32c"]), (2, "<f4", ["shuffle", "zlib"])])
def test_written_arrays_are_read_back(spark, tmp_path, version, data_type, chain):
    data = np.arange(7 * 3, dtype="f8").reshape(7, 3)
    rows = spark.createDataFrame([(k, data[k].tolist()) for k in (0, 1, 3, 6)], "y long, a array<double>")  # chunk 4 to 5 has no row
    chunks = zarr.chunk_rows(rows, "y", "a", 3, 2)
    zarr.write(chunks, str(tmp_path / "s.zarr"), "g/m", ["y", "x"], [7, 3], [2, 3], {"units": "K"}, chain, version, data_type)
    found = zarr.variables(spark, str(tmp_path / "s.zarr")).collect()
    assert [(r.name, r.shape, r.dims, r.units) for r in found] == [("g/m", [7, 3], ["y", "x"], "K")]
    data[[2, 4, 5]] = np.nan
    got = as_array(zarr.cells(zarr.chunks(spark, str(tmp_path / "s.zarr"), "g/m"), ["y", "x"]), ["y", "x"], (7, 3))
    assert np.array_equal(got, data, equal_nan=True)


def test_checksums():
    assert codecs.crc32c(b"123456789") == 0xE3069283 and codecs.crc32c(b"") == 0 and codecs.crc32c(bytes(32)) == 0x8A9136AA
    rng = np.random.default_rng(1)
    for n in (1, 3, 4, 5, 255, 256, 1000, 70001):
        data, state = rng.integers(0, 256, n, np.uint8).tobytes(), 0xFFFFFFFF
        for byte in data:
            state ^= byte
            for _ in range(8):
                state = state >> 1 ^ (0x82F63B78 if state & 1 else 0)
        assert codecs.crc32c(data) == state ^ 0xFFFFFFFF
    chain = [{"name": "crc32c"}]
    assert codecs.decode(codecs.encode(b"chunk", chain, 1), chain, 1, verify=True) == b"chunk"
    with pytest.raises(codecs.DamagedChunk):
        codecs.decode(b"chunk\0\0\0\0", chain, 1, verify=True)


def test_unwritable_codec_is_an_error():
    with pytest.raises(codecs.UnsupportedCodec):
        codecs.encode(b"", [{"name": "pcodec"}], 1)


def test_steps_of_netcdf(spark, tmp_path):
    raw, t = netcdf_bytes()
    (tmp_path / "a.nc").write_bytes(raw)
    pick = lambda s: sorted(tuple(r.origin) for r in netcdf3.chunks(spark, str(tmp_path), "temp", s).collect())
    assert pick(Index(1)) == [(1, 0, 0)] and pick(Range(0, 9)) == [(0, 0, 0), (1, 0, 0)] and pick(Range(5, 9)) == []
    assert netcdf3.chunks(spark, str(tmp_path), "lat").first().shape == [2]


@pytest.mark.parametrize("nside", [1, 2, 4, 5, 8])
def test_corners_enclose_the_pixel(spark, nside):
    """A point most of the way from a pixel's centre to any of its corners lies in that pixel, and corners are shared by the pixels that meet there."""
    c = healpix.pix2ang(nside, F.col("id"))
    rows = spark.range(12 * nside * nside).select(F.col("id").alias("pix"), c["lon"].alias("lon"), c["lat"].alias("lat"), F.posexplode(grids.pixel_outline(nside, F.col("id"))).alias("k", "c"))
    near = F.col("lon") + 0.9 * (F.pmod(F.col("c.lon") - F.col("lon") + math.pi, F.lit(2 * math.pi)) - math.pi)
    z = F.sin("lat") + 0.9 * (F.sin("c.lat") - F.sin("lat"))
    got = rows.select("pix", "k", "c.*", healpix.ang2pix(nside, near, F.asin(z)).alias("found")).collect()
    assert all(r.pix == r.found for r in got)
    shared = {}
    for r in got:
        key = (0 if abs(abs(r[3]) - math.pi / 2) < 1e-6 else round(math.cos(r[2]), 5), 0 if abs(abs(r[3]) - math.pi / 2) < 1e-6 else round(math.sin(r[2]), 5), round(r[3], 5))
        shared.setdefault(key, set()).add(r.pix)
    assert len(shared) == 12 * nside * nside + 2  # as many corners as a sphere cut into such squares has
    assert all(len(v) in (3, 4) for v in shared.values())


@pytest.mark.parametrize("nested", [False, True])
@pytest.mark.parametrize("surface", [False, True])
def test_a_pixel_is_found_at_its_centre(spark, nested, surface):
    at = grids.pixel_centre(8, F.col("id"), nested, surface)
    rows = spark.range(768).select("id", at.alias("c")).select("id", "c.*", grids.norm_pixel(8, F.col("c.u"), F.col("c.v"), surface).alias("ring"))
    got = rows.withColumn("back", healpix.ring2nest(8, F.col("ring")) if nested else F.col("ring")).collect()
    assert all(r.id == r.back and 0 <= r.u <= 1 and 0 <= r.v <= 1 for r in got)


def test_places_on_axes(spark):
    axis = spark.createDataFrame([("a", 0, 10.0), ("a", 1, 15.0), ("a", 2, 30.0), ("b", 0, 5.0), ("b", 1, 7.0), ("b", 2, 5.0), ("c", 4, 3.0), ("d", 0, 9.0), ("d", 1, 1.0), (None, 0, 1.0)], "g string, idx int, value double")
    got = {(r.g, r.idx): r.share for r in grids.axis_places(axis, "g").collect()}
    assert got == {("a", 0): 0, ("a", 1): 0.25, ("a", 2): 1, ("b", 0): 0, ("b", 1): 1, ("b", 2): 0, ("c", 4): 0.5, ("d", 0): 0, ("d", 1): 1, (None, 0): 0.5}

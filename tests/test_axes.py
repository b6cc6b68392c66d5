"""Dates and labels of axes, ticks, trees of variables, kinds and readers of stores, palettes: cases that the tables do not hold."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import axes, scale
from gridloom.operators import catalog, grids, relate
from gridloom.operators.select import Index, Range
from gridloom.sources import geotiff, netcdf3, procedural, store, zarr
from tests.test_sources import tiff_bytes


def day(*ymd):
    return datetime.date(*ymd)


def test_iso_dates(spark):
    cases = {
        "2001-02-03": day(2001, 2, 3), "1979-1-1T00:00:00": day(1979, 1, 1), " 2020-02-29 x": day(2020, 2, 29), "2001-02-03-9": day(2001, 2, 3), "0800-01-01": day(800, 1, 1),
        "2021-02-29": None, "2001-13-01": None, "2001-02": None, "2001-02-03Z": None, "x": None, "": None, None: None,
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", axes.iso_date(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in rows} == cases


def test_references(spark):
    cases = [  # units, start, resolution, address, first day, days
        (None, None, None, None, day(1979, 1, 1), 8),
        ("days since 1970-01-01", None, None, None, day(1970, 1, 1), 1),
        ("d since 1970-01-01", None, "16D", None, day(1970, 1, 1), 1),
        ("hours since 2000-01-01", None, "16D", None, day(2000, 1, 1), 16),
        ("days since then", None, None, "a/daily", day(1979, 1, 1), 1),
        ("days since 1970-01-01", "2001-01-05", "2 days", None, day(2001, 1, 5), 2),
        (None, None, None, "SeasFire.zarr", day(2001, 1, 1), 8),
        (None, None, "xD", "a-16d", day(1979, 1, 1), 8),
        (None, None, "some days", None, day(1979, 1, 1), 1),
        ("", "", "", "", day(1979, 1, 1), 8),
    ]
    rows = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(cases)], "k int, u string, s string, r string, a string")
    c = F.col
    got = rows.withColumn("at", axes.reference(c("u"), c("s"), c("r"), c("a"))).orderBy("k").select("at.day", "at.days", axes.step_date(F.lit(46), c("at")).alias("later"), axes.date_step(axes.step_date(F.lit(46), c("at")), c("at")).alias("back")).collect()
    assert [(r.day, r.days) for r in got] == [c[4:] for c in cases]
    assert all(r.later == r.day + datetime.timedelta(days=46 * r.days) and r.back == 46 for r in got)


def plain_ticks(lo, hi, gamma):
    """Ticks of a logarithmic bar over decades, one by one."""
    a, b = np.log10(lo), np.log10(hi)
    out = []
    for e in range(int(np.floor(a)) - 1, int(np.ceil(b)) + 1):
        for m in range(1, 10):
            v = m * 10.0**e
            if (lo * 0.999 <= v <= hi * 1.001) if m == 1 else lo < v < hi:
                out.append((min(max((np.log10(v) - a) / (b - a), 0), 1) ** gamma, v, m == 1))
    for place, v in ((0.0, lo), (1.0, hi)):
        if not any(abs(t[0] - place) < 0.02 for t in out):
            out.append((place, v, True))
    return sorted(out)


@pytest.mark.parametrize("gamma", [1.0, 2.0])
def test_decades(spark, gamma):
    bars = [(0, 0.03, 47.0), (1, 1.0, 1000.0), (2, -5.0, 3.0), (3, 2.0, 3.0), (4, -3.0, -1.0), (5, float("nan"), 1.0), (6, None, 2.0), (7, 9.99, 10.0), (8, 4.0, 4.0)]
    got = {}
    for r in axes.colorbar_ticks(spark.createDataFrame(bars, "bar int, lo double, hi double"), "lo", "hi", scale.LOG, gamma).collect():
        got.setdefault(r.bar, []).append((r["at"], r.value, r.major))
        assert (r.label is not None) == r.major
    for k, lo, hi in ((0, 0.03, 47.0), (1, 1.0, 1000.0), (2, 1e-12, 3.0)):
        assert np.allclose(np.array(sorted(got[k]), float), np.array(plain_ticks(lo, hi, gamma), float))
    assert {k: len(v) for k, v in got.items() if k > 2} == {3: 21, 4: 21, 7: 21, 8: 21}


@pytest.mark.parametrize("kind", [scale.LINEAR, scale.LOG, scale.SYMLOG, scale.SQRT, scale.EXP])
def test_unscale_takes_columns(spark, kind):
    rows = spark.createDataFrame([(0.0,), (0.3,), (1.0,)], "t double").withColumns({"lo": F.lit(2.0), "hi": F.lit(5.0)})
    for r in rows.select("t", scale.unscale(F.col("t"), F.col("lo"), F.col("hi"), kind).alias("a"), scale.unscale(F.col("t"), 2.0, 5.0, kind).alias("b"), scale.scale(scale.unscale(F.col("t"), F.col("lo"), F.col("hi"), kind), 2.0, 5.0, kind).alias("back")).collect():
        assert r.a == pytest.approx(r.b) and r.back == pytest.approx(r.t, abs=1e-9)


def test_tree_of_odd_paths(spark):
    names = ["/b/x", "a/y/", "root", "b//c/z", "a/q/w"]
    tree = catalog.variable_tree(spark.createDataFrame(list(enumerate(names)), "pos int, name string"))
    assert [(r.path, r.parent, r.depth, r.direct, r.total, r.place) for r in tree.orderBy("path").collect()] == [
        ("", None, 0, 1, 5, 0), ("a", "", 1, 1, 2, 1), ("a/q", "a", 2, 0 + 1, 1, 0), ("b", "", 1, 1, 2, 0), ("b/c", "b", 2, 1, 1, 0),
    ]
    assert catalog.variable_tree(spark.createDataFrame([], "pos int, name string")).count() == 0


def test_summaries_are_ordered(spark):
    blocks = spark.createDataFrame([("s2", "b", 1), ("s1", "b", 2), ("s2", "a", 3)], "source string, variable string, bytes long")
    assert [(r.variable, r.source) for r in catalog.cache_summary(blocks).collect()] == [("a", "s2"), ("b", "s1"), ("b", "s2")]


def test_candidates_rank_without_gaps(spark):
    rows = [(k, f"v{k % 700}", [3], [f"d{k % 40}"], None) for k in range(1500)]
    found = grids.coordinate_candidates(spark.createDataFrame(rows, "pos int, name string, shape array<long>, dims array<string>, attributes map<string,string>")).collect()
    want = list(dict.fromkeys([f"v{k}" for k in range(700)] + [f"d{k}" for k in range(40)] + grids.COORDINATE_NAMES))
    assert {r.candidate: r["rank"] for r in found} == {n: k for k, n in enumerate(want, 1)}


def test_grid_without_attributes(spark):
    axis = [(1, "x", "cell", 48, 0, None), (1, "y", "b", 1, 0, None), (2, "x", "p", 48, 0, None), (2, "y", "q", 1, 0, None)]
    rows = spark.createDataFrame(axis, "k int, axis string, dim string, size long, idx int, value double")
    for known in ([(1, None)], []):
        blocks = spark.createDataFrame(known, "k int, attributes map<string,string>")
        assert sorted((r.k, r.kind, r.nside, r.ordering) for r in grids.detect(rows, "k", blocks=blocks).collect()) == [(1, "healpix", 2, "ring"), (2, "global", None, None)]


def test_kinds_of_folders(tmp_path):
    for name, marker, kind in (("a", "snapshots", "icechunk"), ("b", ".zgroup", "zarr"), ("c", "zarr.json", "zarr")):
        (tmp_path / name / marker).mkdir(parents=True)
        assert store.kind_of(str(tmp_path / name)) == kind
    (tmp_path / "empty").mkdir()
    for target in (str(tmp_path / "empty"), "", "  ", str(tmp_path / "none"), "ftp://x/y"):
        with pytest.raises(store.UnsupportedStore):
            store.kind_of(target)
    assert [store.kind_of(t) for t in ("hdf5://a", "icechunk+s3://b/c", "A.HE5", "zarr://x/y", "s3://b/c.cog?q=.zarr")] == ["netcdf", "icechunk", "netcdf", "zarr", "geotiff"]
    with pytest.raises(store.UnsupportedStore):
        store.open_variables(None, str(tmp_path / "a"))


def test_one_reader_for_all_kinds(spark, tmp_path):
    data = np.arange(12.0).reshape(3, 4)
    folder = tmp_path / "s.zarr" / "t"
    folder.mkdir(parents=True)
    (folder / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [3, 4], "chunks": [3, 4], "dtype": "<f4", "fill_value": "NaN", "order": "C", "filters": None, "compressor": None}))
    (folder / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": ["y", "x"]}))
    (folder / "0.0").write_bytes(data.astype("<f4").tobytes())
    (tmp_path / "a.nc").write_bytes(netcdf3.encode(["y", "x"], [0.0, 1.0, 2.0], "t", data))
    (tmp_path / "a.tif").write_bytes(geotiff.encode(data, 16))
    for target, variable in ((tmp_path / "s.zarr", "t"), (tmp_path / "a.nc", "t"), (tmp_path / "a.tif", None)):
        got = store.open_cells(spark, str(target), variable, y=Range(1, 9), x=Index(2)).collect()
        assert sorted((r.y, r.x, r.v) for r in got) == [(1, 2, 6.0), (2, 2, 10.0)]
    assert zarr.Layout(zarr.open_array(str(tmp_path / "s.zarr"), "t")).dims == ["y", "x"]


def test_palette_rows(spark, tmp_path):
    shades = [k * 257 for k in range(256)]
    codes = np.arange(12, dtype="u1").reshape(3, 4, 1) * 20
    (tmp_path / "p.tif").write_bytes(tiff_bytes(codes, extra=[(262, 3, [3]), (320, 3, shades + shades[::-1] + [0] * 256)]))
    table = geotiff.palettes(spark, str(tmp_path / "p.tif"))
    assert table.count() == 256
    path = table.first()["path"]
    cells = spark.createDataFrame([(path, 0), (path, 255), (path, 256), (path, None)], "path string, code int")
    got = {r.code: (r.r, r.g, r.b) for r in relate.palette_colours(cells, table, ["path", "code"], ["r", "g", "b"]).collect()}
    assert got[256] == got[None] == (None, None, None) and got[0] == pytest.approx((0, 255, 0)) and got[255] == pytest.approx((255, 0, 0))
    # The reader expands the same colours by itself.
    for band, colour in enumerate(("r", "g", "b")):
        seen = {(r.y, r.x): r.v for r in store.open_cells(spark, str(tmp_path / "p.tif"), str(band)).collect()}
        told = {r.code: r[colour] for r in table.collect()}
        assert all(seen[y, x] == pytest.approx(told[int(codes[y, x, 0])]) for y in range(3) for x in range(4))


def test_files_without_palette(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(geotiff.encode(np.zeros((2, 2)), 16))
    assert geotiff.palettes(spark, str(tmp_path / "a.tif")).count() == 0


def test_parts_of_closed_forms(spark):
    sizes = {"t": 4, "x": 6}
    rows = lambda **w: sorted(tuple(r) for r in procedural.block(spark, sizes, **w).collect())
    assert rows() == [(t, x) for t in range(4) for x in range(6)]
    assert rows(t=Range(2, 9), x=Index(5)) == [(2, 5), (3, 5)]
    assert rows(t=Range(7, 9)) == []

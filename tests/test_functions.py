"""Closed forms and round trips of the scalar functions and grids."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import fmt, healpix, scale
from gridloom.operators import coords, pyramid, reduce, select
from gridloom.sources import procedural


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("nside", [1, 2, 4, 8])
def test_healpix_round_trips(spark, nside):
    p = spark.range(12 * nside * nside).withColumn("a", healpix.pix2ang(nside, F.col("id")))
    p = p.withColumn("back", healpix.ang2pix(nside, F.col("a.lon"), F.col("a.lat"))).withColumn("ring", healpix.nest2ring(nside, F.col("id"))).withColumn("nest", healpix.ring2nest(nside, F.col("ring")))
    assert p.where("back <> id OR nest <> id OR back IS NULL OR nest IS NULL").count() == 0
    assert p.select("ring").distinct().count() == 12 * nside * nside


def test_first_ring(spark):
    rows = spark.range(4).select(healpix.pix2ang(16, F.col("id")).alias("a")).collect()
    assert [round(math.degrees(r.a.lon), 6) for r in rows] == [45.0, 135.0, 225.0, 315.0]
    assert all(abs(math.degrees(r.a.lat) - 87.07582) < 1e-4 for r in rows)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**29 - 1), st.integers(0, 2**29 - 1)), min_size=1, max_size=20))
def test_interleaving_is_reversible(spark, pairs):
    df = spark.createDataFrame(pairs, "x long, y long").withColumn("b", healpix.deinterleave(healpix.interleave(F.col("x"), F.col("y"))))
    assert df.where("b.x <> x OR b.y <> y").count() == 0


@pytest.mark.parametrize("kind", range(5))
def test_scale_and_back(spark, kind):
    df = spark.range(1, 100).select(F.col("id").cast("double").alias("v"))
    out = df.select("v", scale.unscale(scale.scale(F.col("v"), 1.0, 100.0, kind), 1.0, 100.0, kind).alias("w"))
    assert out.where(F.abs(F.col("v") - F.col("w")) > 1e-6).count() == 0


def test_missing_values_stay_missing(spark):
    v = F.lit(None).cast("double")
    assert one(spark, scale.scale(v, 0.0, 1.0)) is None
    assert one(spark, scale.surface_height(F.lit(float("nan")), 0.0, 1.0)) == 0.0
    assert one(spark, select.visible(F.lit(float("inf")), 0.0, 1.0)) is False


def test_calibration(spark):
    df = spark.createDataFrame([(10000.0,), (-9999.0,), (-6000.0,), (25000.0,), (float("nan"),)], "raw double")
    got = [r.v for r in df.select(select.calibrate(F.col("raw"), 1e-4, 10.0, -9999.0, -5000.0, 20000.0).alias("v")).collect()]
    assert got[0] == pytest.approx(11.0) and got[1:] == [None] * 4


def test_bounds_of_nothing(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (float("inf"),)], "v double")
    assert tuple(reduce.bounds(df).first()) == (0.0, 1.0)
    assert tuple(reduce.bounds(spark.createDataFrame([(1.0,), (float("nan"),), (5.0,), (-2.0,), (float("inf"),), (3.0,)], "v double")).first()) == (-2.0, 5.0)


@pytest.mark.parametrize("how,want", [("mean", 25.0), ("max", 40.0), ("min", 10.0), ("nearest", 10.0)])
def test_halving(spark, how, want):
    df = spark.createDataFrame([(0, 0, 10.0), (0, 1, 20.0), (1, 0, 30.0), (1, 1, 40.0)], "y long, x long, v double")
    assert pyramid.halve(df, how).first().v == want


def test_levels():
    assert pyramid.level_sizes(2048, 1024, 512) == [(2048, 1024), (1024, 512), (512, 256)]
    assert [pyramid.level_for(s, 100, 4) for s in (50, 200, 400, 5000)] == [0, 1, 2, 3]


def test_requests():
    assert select.clamp_request(select.Range(90, 120), 64) == select.Range(63, 64)
    assert select.clamp_projection(select.Range(90, 120), 64) == select.Range(64, 64)
    assert select.chunk_range(select.Range(5, 17), 8) == (0, 2)


def test_byte_sizes_and_ticks(spark):
    df = spark.createDataFrame([(500, 0.0), (1536, 0.0001), (1048576, 12345.0), (3 * 1024**3, 0.25), (2048, 12.0)], "n long, v double")
    rows = df.select(fmt.byte_size(F.col("n")).alias("b"), fmt.tick(F.col("v")).alias("t")).collect()
    assert [r.b for r in rows] == ["500 B", "1.5 KB", "1 MB", "3 GB", "2 KB"]
    assert [r.t for r in rows] == ["0", "1e-4", "1.23e4", "0.25", "12"]


@pytest.mark.parametrize("v,unit,want", [(12.0, "hours since 2024-01-01", "01-01-2024 12:00"), (-5.0, "hours since 2024-01-01", "12-31-2023 19:00"), (0.0, "seconds", "0 h"), (90.0, "min", "90 min"), (120.0, "s", "2 min"), (36.0, "h", "36 h"), (2.0, "days", "2 d"), (1.5, "degrees_east", "1.50°"), (7.0, "K", "7.00")])
def test_cf_time(spark, v, unit, want):
    assert one(spark, fmt.cf_time(F.lit(v), F.lit(unit))) == want


def test_packet_peak(spark):
    at = procedural.packet_volume(spark, 5, 8, 12, 16)
    top = at.where("t = 0").orderBy(F.desc("v")).first()
    assert at.count() == 5 * 8 * 12 * 16 and abs(top.x - 0.8 * 15) <= 1 and abs(top.y - 0.5 * 11) <= 1 and abs(top.z - 0.2 * 7) <= 1


@settings(max_examples=6, deadline=None)
@given(st.lists(st.floats(-50, 150), min_size=1, max_size=15), st.lists(st.floats(0.1, 9), min_size=1, max_size=12))
def test_nearest_equals_brute_force(spark, values, steps):
    axis = [0.0]
    for s in steps:
        axis.append(axis[-1] + s)
    a = spark.createDataFrame(list(enumerate(axis)), "idx long, value double")
    p = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id long, p double")
    got = {r.id: r.idx for r in coords.nearest(p, "p", a).collect()}
    for k, v in enumerate(values):
        inside = min(max(v, axis[0]), axis[-1])
        best = min(abs(inside - x) for x in axis)
        assert abs(abs(inside - axis[got[k]]) - best) < 1e-9

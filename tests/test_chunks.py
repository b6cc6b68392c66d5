"""Stencils by exchanged layers, nearest places in sorted ranges, and rays in slabs, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import coords, reduce, stencil


def cells_of(spark, a, names, skip=()):
    rows = [(*map(int, i), None if np.isnan(a[i]) else float(a[i])) for i in np.ndindex(a.shape) if i not in skip]
    return spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names) + ", v double")


def plain_sobel(a):
    """By the definition: all neighbours of each cell, places beyond an edge moved back to it."""
    z = np.nan_to_num(a)
    out = [np.zeros(a.shape) for _ in range(a.ndim)]
    for o in np.ndindex((3,) * a.ndim):
        step = [x - 1 for x in o]
        seen = z[np.ix_(*[np.clip(np.arange(n) + s, 0, n - 1) for n, s in zip(a.shape, step, strict=True)])]
        for k in range(a.ndim):
            out[k] -= step[k] * 2 ** sum(s == 0 for j, s in enumerate(step) if j != k) * seen
    return out


@pytest.mark.parametrize("shape,size", [((7, 9, 4), (3, 4, 2)), ((5, 6), (2, 3)), ((1, 8, 3), (4, 2, 1)), ((6, 6), (6, 6)), ((11,), (4,))])
def test_gradient_over_chunk_borders(spark, shape, size):
    a = np.random.default_rng(7).normal(size=shape)
    a.ravel()[::11] = np.nan
    names = ["z", "y", "x"][: len(shape)]
    axes, sizes = dict(zip(names, shape, strict=True)), dict(zip(names, size, strict=True))
    chunks = stencil.to_chunks(cells_of(spark, a, names), axes, sizes)
    grid = {d: -(-n // sizes[d]) for d, n in axes.items()}
    rows = stencil.to_cells(stencil.gradient(chunks, grid, sizes), names, [f"g_{d}" for d in names]).collect()
    assert len(rows) == a.size
    want = plain_sobel(a)
    for r in rows:
        at = tuple(r[d] for d in names)
        assert [r[f"g_{d}"] for d in names] == pytest.approx([w[at] for w in want])


def test_chunks_send_their_surface_only(spark):
    a = np.arange(40.0 * 40).reshape(40, 40)
    chunks = stencil.to_chunks(cells_of(spark, a, ["y", "x"]), {"y": 40, "x": 40}, {"y": 10, "x": 10})
    sent = stencil.halos(chunks, {"y": 4, "x": 4})
    assert sent.agg(F.sum(F.size("values"))).first()[0] == 2 * (3 * 4 * 10) * 2 + 4 * 9  # faces both ways, and corners
    plan = stencil.gradient(chunks, {"y": 4, "x": 4}, {"y": 10, "x": 10})._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_chunks_that_are_missing_count_as_zero(spark):
    a = np.ones((6, 6))
    a[0:3, 3:6] = np.nan
    skip = {(y, x) for y in range(3) for x in range(3, 6)}
    sizes = {"y": 3, "x": 3}
    chunks = stencil.to_chunks(cells_of(spark, a, ["y", "x"], skip), {"y": 6, "x": 6}, sizes)
    assert chunks.count() == 3
    got = {(r.y, r.x): (r.g_y, r.g_x) for r in stencil.to_cells(stencil.gradient(chunks, {"y": 2, "x": 2}, sizes), ["y", "x"], ["g_y", "g_x"]).collect()}
    want = plain_sobel(a)
    assert all(v == pytest.approx((want[0][k], want[1][k])) for k, v in got.items()) and len(got) == 27


def plain_nearest(p, axis, period=None):
    values, ids = [v for _, v in axis], [i for i, _ in axis]
    p = values[0] + (p - values[0]) % period if period else min(max(p, values[0]), values[-1])
    k = max(k for k, v in enumerate(values) if v <= p)
    b, ib = (values[k + 1], ids[k + 1]) if k + 1 < len(values) else ((values[0] + period, ids[0]) if period else (values[-1], ids[-1]))
    return ids[k] if p - values[k] <= b - p else ib


@pytest.mark.parametrize("short", [0, 512])
@pytest.mark.parametrize("period", [None, 360.0])
def test_nearest_in_sorted_ranges(spark, short, period):
    rng = np.random.default_rng(8)
    axis = [(k, float(v)) for k, v in enumerate(np.sort(rng.choice(3600, 300, replace=False) / 10))]
    if period is None:
        axis[-1] = (299, 1e9)
    points = [(k, float(v)) for k, v in enumerate(np.concatenate([rng.integers(-8000, 8000, 900) / 20, np.full(700, 123.45), [v for _, v in axis[::9]], [1e12, -1e12, 5e8]]))] + [(5000, None), (5001, float("nan"))]
    df = spark.createDataFrame([(*p, "kept") for p in points], "id long, p double, place string")
    out = coords.nearest(df, "p", spark.createDataFrame(axis, "idx long, value double"), slots=16, period=period, short=short)
    assert out.columns == ["id", "p", "place", "idx"]
    got = {r.id: r.idx for r in out.collect()}
    assert got == {k: None if v is None or v != v else plain_nearest(v, axis, period) for k, v in points}


def test_short_axes_need_no_exchange(spark):
    axis = spark.range(100).select(F.col("id").alias("idx"), (F.col("id") * 1.5).alias("value"))
    assert "Exchange" not in coords.nearest(spark.range(10).select(F.col("id").cast("double").alias("p")), "p", axis)._jdf.queryExecution().executedPlan().toString()
    none = coords.nearest(spark.range(3).select(F.col("id").cast("double").alias("p")), "p", axis.where("false"))
    assert [r.idx for r in none.collect()] == [None] * 3


def test_no_slot_is_much_larger_than_the_others(spark):
    """An outlier of the axis and a value that a third of all points have leave no group far above the mean."""
    axis = spark.range(20000).select(F.col("id").alias("idx"), F.when(F.col("id") == 19999, 1e9).otherwise(F.col("id") * 0.37).alias("value"))
    points = spark.range(60000).select("id", F.when(F.col("id") % 3 == 0, 42.0).otherwise(F.col("id") * 0.11).alias("p"))
    out = coords.nearest(points, "p", axis, slots=64)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan
    sizes = out.select(F.spark_partition_id().alias("s")).groupBy("s").count().collect()
    assert max(r["count"] for r in sizes) < 60000 / 2
    assert out.where("idx IS NULL").count() == 0 and out.count() == 60000


def test_numbered(spark):
    values = [5.0, -1.0, 5.0, 1e9, None, 0.0, 3.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = sorted((r.idx, r.v) for r in coords.numbered(df, "v", slots=3).collect())
    assert got == list(enumerate([-1.0, 0.0, 3.0, 5.0, 5.0, 1e9, None]))
    assert coords.numbered(df.where("false"), "v").count() == 0


@pytest.mark.parametrize("slab", [1, 5, 1000])
def test_composite(spark, slab):
    rng = np.random.default_rng(9)
    rows = [(r, z, float(rng.random()) if rng.random() > 0.1 else None) for r in range(5) for z in range(60)] + [(7, 0, None), (8, 0, 1.0), (8, 1, 0.5)]
    out = reduce.composite(spark.createDataFrame(rows, "ray long, z long, v double"), "z", ["ray"], {"red": F.col("v"), "one": F.lit(1.0)}, F.col("v") if slab == 5 else F.col("v") * 0.3, slab)
    got = {r.ray: (r.red, r.one, r.alpha) for r in out.collect()}
    for ray in (0, 1, 2, 3, 4, 8):
        red = one = 0.0
        t = 1.0
        for _, _, v in sorted(x for x in rows if x[0] == ray and x[2] is not None):
            a = v if slab == 5 else v * 0.3
            red, one, t = red + t * a * v, one + t * a, t * (1 - a)
        assert got[ray] == pytest.approx((red, one, 1 - t), abs=1e-9)
    assert 7 not in got

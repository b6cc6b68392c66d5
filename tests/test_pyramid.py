"""All levels of a pyramid from chunks, against halving level by level."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import pyramid, stencil


def plain(a, how):
    h, w = -(-a.shape[0] // 2), -(-a.shape[1] // 2)
    out = np.full((h, w), np.nan)
    for y in range(h):
        for x in range(w):
            box = a[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].ravel()
            good = box[np.isfinite(box)]
            if how == "nearest":
                out[y, x] = box[0]
            elif len(good):
                out[y, x] = {"mean": np.mean, "max": np.max, "min": np.min}[how](good)
    return out


@pytest.mark.parametrize("shape,size,upper", [((37, 51), 4, 1), ((64, 64), 16, 6), ((5, 3), 8, 2), ((33, 20), 2, 2)])
def test_levels_from_chunks(spark, tmp_path, monkeypatch, shape, size, upper):
    monkeypatch.setattr(pyramid, "UPPER", upper)
    a = np.random.default_rng(5).normal(size=shape)
    a.ravel()[::7] = np.nan
    a[0, 0] = np.inf
    cells = spark.createDataFrame([(y, x, float(a[y, x])) for y, x in np.ndindex(shape)], "y long, x long, v double")
    chunks = stencil.to_chunks(cells, {"y": shape[0], "x": shape[1]}, {"y": size, "x": size})
    n = len(pyramid.level_sizes(shape[1], shape[0], 1))
    got = {}
    for r in pyramid.store(chunks, str(tmp_path / "p"), size, n).collect():
        block = got.setdefault((r.how, r.level), {})
        for k, v in enumerate(r["values"]):
            place = (r.origin[0] + k // r.shape[1], r.origin[1] + k % r.shape[1])
            assert place not in block
            block[place] = v
    for how in pyramid.HOWS:
        level = a
        for k in range(n):
            assert set(got[how, k]) == set(np.ndindex(level.shape)), (how, k)
            assert all(np.isclose(v, level[p], equal_nan=True) for p, v in got[how, k].items())
            level = plain(level, how)


def test_one_scan_without_exchange(spark):
    chunks = spark.createDataFrame([(0, 0, [2, 2], [1.0, 2.0, 3.0, 4.0])], "c_y long, c_x long, shape array<long>, values array<double>")
    assert "Exchange" not in pyramid.fold_chunks(chunks, 2, 2)._jdf.queryExecution().executedPlan().toString()
    rows = pyramid.fold_chunks(chunks, 2, 2, ("mean",)).orderBy("level").collect()
    assert [(r.level, r["values"]) for r in rows] == [(0, [1.0, 2.0, 3.0, 4.0]), (1, [2.5])]
    assert pyramid.fold_chunks(chunks.where("false"), 2, 2).agg(F.count("*")).first()[0] == 0

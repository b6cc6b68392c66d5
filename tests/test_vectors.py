"""Polylines: GeoJSON of all kinds, cutting at a domain's edge, and levels of detail against a plain version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import vectors


def test_geojson_of_all_kinds(spark):
    line = '{"type": "LineString", "coordinates": [[1, 2, 9], [3.5, 4], [5], ["x", 6]]}'
    many = '{"type": "MultiLineString", "coordinates": [[[1, 2]], [], [[3, 4], [5, 6]]]}'
    docs = [
        (1, '{"type": "Feature", "geometry": ' + line + "}"),
        (2, '{"type": "FeatureCollection", "features": [{"geometry": null}, {"geometry": {"type": "Point", "coordinates": [1, 2]}}, {"geometry": ' + many + '}, {"geometry": {"type": "LineString", "coordinates": 7}}]}'),
        (3, "no json"), (4, None), (5, "{}"), (6, '{"type": "FeatureCollection", "features": []}'),
    ]
    got = [tuple(r) for r in vectors.geojson_vertices(spark.createDataFrame(docs, "k int, t string"), "t", "k").collect()]
    assert sorted(r for r in got if r[0] == 2) == [(2, 2, 0, 0, 1.0, 2.0), (2, 2, 2, 0, 3.0, 4.0), (2, 2, 2, 1, 5.0, 6.0)]
    assert [r[3:] for r in sorted(r for r in got if r[0] == 1)][:3] == [(0, 1.0, 2.0), (1, 3.5, 4.0), (2, 5.0, None)]
    assert {r[0] for r in got} <= {1, 2}


def test_cut(spark):
    rows = [(0, 0.0, 0.0, 1.0, 1.0), (1, -9.0, 0.0, 9.0, 0.0), (2, -9.0, 9.0, 9.0, 8.0), (3, 0.0, 0.0, 9.0, 9.0), (4, 5.0, 0.0, 7.0, 0.0), (5, 3.0, 3.0, 3.0, 3.0), (6, 5.0, -9.0, 5.0, 9.0), (7, 6.0, -9.0, 6.0, 9.0), (8, 4.0, 6.0, 6.0, 4.0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id int, lon1 double, lat1 double, lon2 double, lat2 double, tag string")
    got = {r.id: tuple(r)[1:5] for r in vectors.cut(df, -5.0, 5.0, -5.0, 5.0).collect()}
    assert got == {0: (0.0, 0.0, 1.0, 1.0), 1: (-5.0, 0.0, 5.0, 0.0), 3: (0.0, 0.0, 5.0, 5.0), 6: (5.0, -5.0, 5.0, 5.0)}


def plain_simplify(points, tolerance):
    """Kept numbers, by recursion."""
    if len(points) < 3:
        return set(range(len(points)))
    (ax, ay), (bx, by) = points[0], points[-1]
    dx, dy = bx - ax, by - ay
    best, at = -1.0, 0
    for k, (x, y) in enumerate(points[1:-1], 1):
        t = min(1.0, max(0.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        apart = np.hypot(x - ax - t * dx, y - ay - t * dy)
        if apart > best:
            best, at = apart, k
    if best <= tolerance:
        return {0, len(points) - 1}
    return plain_simplify(points[: at + 1], tolerance) | {at + k for k in plain_simplify(points[at:], tolerance)}


@pytest.mark.parametrize("piece", [7, 4096])
def test_levels(spark, monkeypatch, piece):
    monkeypatch.setattr(vectors, "PIECE", piece)
    rng = np.random.default_rng(12)
    lines = {k: np.cumsum(rng.normal(size=(n, 2)), axis=0).tolist() for k, n in enumerate((1, 2, 3, 40, 61))}
    lines[5] = [[0.0, 0.0], [1.0, 1.0], [0.0, 0.0], [1.0, 1.0], [0.0, 0.0]]
    rows = [(k, i, x, y, "kept") for k, p in lines.items() for i, (x, y) in enumerate(p)]
    df = spark.createDataFrame(rows, "id int, pos long, lon double, lat double, tag string")
    tolerances = [0.0, 0.5, 2.0]
    got = {}
    for r in vectors.levels(df, ["id"], "pos", tolerances).collect():
        got.setdefault((r.level, r.id), set()).add(r.pos)
    for level, t in enumerate(tolerances):
        for k, p in lines.items():
            want = set()
            for start in range(0, max(1, len(p) - 1), piece):
                want |= {start + i for i in plain_simplify(p[start : start + piece + 1], t)}
            assert got[level, k] == want, (level, k)


def test_breaks_stay_at_every_level(spark):
    rows = [(1, k, float(k), 0.0) for k in range(5)] + [(1, 5, None, None)] + [(1, k, float(k), 3.0) for k in range(6, 9)]
    out = vectors.levels(spark.createDataFrame(rows, "id int, pos long, lon double, lat double"), ["id"], "pos", [0.1])
    assert sorted(r.pos for r in out.collect()) == [0, 4, 5, 6, 8]
    assert vectors.segments(out, "id", "pos").count() == 2
    assert vectors.levels(out.drop("level").where("false"), ["id"], "pos", [0.1]).agg(F.count("*")).first()[0] == 0

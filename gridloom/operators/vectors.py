"""Polylines: GeoJSON, segments, breaks, the antimeridian, domains and levels of detail."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def segments(vertices: DataFrame, line: str, order: str) -> DataFrame:
    """line, order, lon1, lat1, lon2, lat2 of successive vertices; a vertex without coordinates breaks the line."""
    w = Window.partitionBy(line).orderBy(order)
    pair = vertices.select(line, order, F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), F.lead("lon").over(w).alias("lon2"), F.lead("lat").over(w).alias("lat2"))
    known = [F.col(c).isNotNull() & ~F.isnan(c) for c in ("lon1", "lat1", "lon2", "lat2")]
    return pair.where(known[0] & known[1] & known[2] & known[3])


def split_antimeridian(parts: DataFrame) -> DataFrame:
    """Segments that cross 180 degrees become two, meeting it at the latitude in between."""
    far = F.abs(F.col("lon1") - F.col("lon2")) > 180
    side = F.when(F.col("lon1") > 0, 180.0).otherwise(-180.0)
    reach = F.abs(side - F.col("lon1"))
    share = reach / (reach + F.abs(side + F.col("lon2")))
    lat = F.col("lat1") + share * (F.col("lat2") - F.col("lat1"))
    part = lambda n, a, b, c, d: F.struct(F.lit(n).alias("part"), a.alias("lon1"), b.alias("lat1"), c.alias("lon2"), d.alias("lat2"))
    a, b, c, d = (F.col(x) for x in ("lon1", "lat1", "lon2", "lat2"))
    both = F.when(far & (reach + F.abs(side + c) > 0), F.array(part(0, a, b, side, lat), part(1, -side, lat, c, d))).otherwise(F.array(part(0, a, b, c, d)))
    return parts.withColumn("_p", F.explode(both)).select(*[x for x in parts.columns if x not in ("lon1", "lat1", "lon2", "lat2")], "_p.*")


def crop(parts: DataFrame, west: float, east: float, south: float, north: float) -> DataFrame:
    """Segments with both ends inside a domain."""
    inside = lambda k: F.col(f"lon{k}").between(west, east) & F.col(f"lat{k}").between(south, north)
    return parts.where(inside(1) & inside(2))


def cut(parts: DataFrame, west: float, east: float, south: float, north: float) -> DataFrame:
    """The part of each segment that is inside a domain; segments that only touch its border from outside, or that are a point, go.

    A segment's points are its start plus t times its way, t from 0 to 1; each side of the domain moves the lower or the upper end of t."""
    dx, dy = F.col("lon2") - F.col("lon1"), F.col("lat2") - F.col("lat1")
    # Room towards a side at the start, and how fast the segment uses it up.
    sides = [(-dx, F.col("lon1") - west), (dx, east - F.col("lon1")), (-dy, F.col("lat1") - south), (dy, north - F.col("lat1"))]
    enter = F.greatest(F.lit(0.0), *[F.when(speed < 0, room / speed) for speed, room in sides])
    leave = F.least(F.lit(1.0), *[F.when(speed > 0, room / speed) for speed, room in sides])
    outside = F.lit(False)
    for speed, room in sides:
        outside = outside | ((speed == 0) & (room < 0))
    at = parts.withColumns({"_enter": enter, "_leave": leave}).where(~outside & ((dx != 0) | (dy != 0)) & (F.col("_enter") < F.col("_leave")))
    # Ends inside stay what they are, to the last bit.
    place = lambda k, t, c: F.when(F.col(t) == k, F.col(f"{c}{k + 1}")).otherwise(F.col(f"{c}1") + F.col(t) * (F.col(f"{c}2") - F.col(f"{c}1")))
    ends = {"lon1": place(0, "_enter", "lon"), "lat1": place(0, "_enter", "lat"), "lon2": place(1, "_leave", "lon"), "lat2": place(1, "_leave", "lat")}
    return at.withColumns(ends).drop("_enter", "_leave")


FEATURES = "features array<struct<geometry:struct<type:string,coordinates:string>>>, type string, geometry struct<type:string,coordinates:string>"


def geojson_vertices(documents: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, feature, part, pos, lon and lat of the vertices of all lines in GeoJSON texts (a collection or one feature a row).

    Lines and multiple lines count; other geometries, and features without one, are passed over, as are texts that are no GeoJSON.  Places keep
    their numbers: a vertex without two numbers has nulls, which break the line in ``segments``."""
    read = documents.select(*keys, F.from_json(text, FEATURES).alias("_j"))
    one = F.struct(F.col("_j.geometry").alias("geometry"))
    features = read.select(*keys, F.posexplode(F.when(F.col("_j.type") == "Feature", F.array(one)).otherwise(F.col("_j.features"))).alias("feature", "_f"))
    kind, coordinates = F.col("_f.geometry.type"), F.col("_f.geometry.coordinates")
    lines = F.when(kind == "LineString", F.array(F.from_json(coordinates, "array<array<string>>"))).when(kind == "MultiLineString", F.from_json(coordinates, "array<array<array<string>>>"))
    parts = features.select(*keys, "feature", F.posexplode(lines).alias("part", "_l"))
    vertices = parts.select(*keys, "feature", "part", F.posexplode("_l").alias("pos", "_v"))
    number = lambda k: F.get("_v", F.lit(k)).try_cast("double")
    return vertices.select(*keys, "feature", "part", "pos", number(0).alias("lon"), number(1).alias("lat"))


#: Vertices of a line that are simplified together.
PIECE = 4096


def significance(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """For each vertex the largest tolerance at which it stays when the line is simplified by farthest vertices; the ends always stay.

    Between two vertices that stay, the one farthest from the chord stays while its distance is over the tolerance; what lies on either side of it
    can only stay while it does."""
    out = np.zeros(len(lon))
    out[[0, -1]] = np.inf
    open_ = [(0, len(lon) - 1, np.inf)]
    while open_:
        a, b, most = open_.pop()
        if b - a < 2:
            continue
        x, y = lon[a + 1 : b] - lon[a], lat[a + 1 : b] - lat[a]
        dx, dy = lon[b] - lon[a], lat[b] - lat[a]
        long = dx * dx + dy * dy
        t = np.clip((x * dx + y * dy) / long, 0, 1) if long else np.zeros(len(x))
        apart = np.hypot(x - t * dx, y - t * dy)
        k = int(apart.argmax())
        far = min(most, float(apart[k]))
        out[a + 1 + k] = far
        if far > 0:
            open_ += [(a, a + 1 + k, far), (a + 1 + k, b, far)]
    return out


def levels(vertices: DataFrame, line: list[str], order: str, tolerances: list[float]) -> DataFrame:
    """level, and the vertices that are left at each of the ``tolerances``; all levels come from one measure of each vertex.

    ``order`` numbers a line's vertices.  A long line is cut into pieces of PIECE vertices, whose ends stay at every level, so no group grows with a line.
    Vertices without coordinates stay where they are, as breaks."""
    from gridloom import ship

    ship(vertices.sparkSession)
    piece = F.floor(F.col(order) / PIECE).cast("long")
    # The first vertex of a piece is the last of the one before it, too.
    own = F.when((F.col(order) % PIECE == 0) & (F.col(order) > 0), F.array(piece, piece - 1)).otherwise(F.array(piece))
    shared = vertices.select(*line, F.col(order).cast("long").alias("_o"), F.col("lon").cast("double").alias("_x"), F.col("lat").cast("double").alias("_y"), F.explode(own).alias("_piece"))
    keys = [*line, "_piece"]
    types = dict(vertices.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_o", kind="stable")
        lon, lat = group["_x"].to_numpy(), group["_y"].to_numpy()
        known = ~(np.isnan(lon) | np.isnan(lat))
        kept = np.full(len(lon), np.inf)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], known.astype(int), [0]])))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            kept[a:b] = significance(lon[a:b], lat[a:b])
        return group[line].assign(_o=group["_o"], _kept=kept)

    measured = shared.groupBy(*keys).applyInPandas(run, ", ".join(f"`{c}` {types[c]}" for c in line) + ", _o long, _kept double")
    best = measured.groupBy(*line, "_o").agg(F.max("_kept").alias("_kept"))
    met = vertices.join(best.withColumnRenamed("_o", order), [*line, order])
    wanted = F.filter(F.array(*[F.struct(F.lit(k).alias("level"), F.lit(float(t)).alias("t")) for k, t in enumerate(tolerances)]), lambda s: F.col("_kept") > s["t"])
    return met.select(F.explode(wanted).alias("_l"), *vertices.columns).select("_l.level", *vertices.columns)

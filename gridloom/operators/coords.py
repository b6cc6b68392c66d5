"""Coordinates: attaching, nearest lookup, irregular axes, cell bounds, and longitude and latitude to cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scale import slot_of


def interpolated(index: Column, size: int, first: float, last: float) -> Column:
    """Coordinate of an index where only the ends are known."""
    return F.lit(first) + index * ((last - first) / max(size - 1, 1))


def attach(cells: DataFrame, coords: DataFrame, dim: str, name: str = "coordinate") -> DataFrame:
    """Add the coordinate (idx, value) of a dimension; the planner broadcasts the axis if it is small."""
    return cells.join(coords.select(F.col("idx").alias(dim), F.col("value").alias(name)), dim, "left")


def numbered(rows: DataFrame, order: str, name: str = "idx", slots: int = 256) -> DataFrame:
    """``rows`` with their places (from 0) in ascending order of a number, as a long: rows are numbered within the ranges between quantiles, and each range
    starts where the ones before it end.  Rows without a number are last."""
    edges = sorted(set(rows.agg(F.percentile_approx(order, [k / slots for k in range(1, slots)], 20 * slots)).first()[0] or []))
    placed = rows.withColumn("_slot", F.coalesce(slot_of(order, edges), F.lit(len(edges) + 1)))
    counts = {r[0]: r[1] for r in placed.groupBy("_slot").count().collect()}  # one number a range
    starts = [sum(n for s, n in counts.items() if s < k) for k in range(len(edges) + 2)]
    inside = F.row_number().over(Window.partitionBy("_slot").orderBy(order)) - 1
    return placed.withColumn(name, F.element_at(F.array(*[F.lit(n).cast("long") for n in starts]), F.col("_slot") + 1) + inside).drop("_slot")


#: Axes of so many places at most are compared within the rows' own tasks.
SHORT = 512


def nearest(points: DataFrame, value: str, axis: DataFrame, slots: int | None = None, period: float | None = None, short: int = SHORT) -> DataFrame:
    """Add ``idx``, the nearest place on an axis (idx, value, ascending); ties go to the lower, points outside to the ends, points without a
    value get none.  With a ``period`` (360 for longitudes) the axis goes round: points are turned into it, and its last place has the first after it.

    A short axis goes with the expression, as a tree of comparisons.  Beyond that both sides are cut at quantiles of both, so no slot is much larger
    than the others whatever the spacing; a slot that still has many points (equal ones) is dealt on, with its stretch of the axis.  Inside a slot both
    are sorted together and each point takes the last place before it; the last place of the slots before is handed over."""
    ends = axis.agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last")).first()
    if not ends.n:
        return points.withColumn("idx", F.lit(None).cast("long"))
    p = F.col(value).cast("double")
    turned = F.lit(float(ends.low)) + F.pmod(p - float(ends.low), F.lit(float(period))) if period else F.greatest(F.lit(float(ends.low)), F.least(F.lit(float(ends.high)), p))
    keyed = points.withColumn("_p", F.when(p.isNotNull() & ~F.isnan(p), turned))
    pick = lambda a, ia, b, ib: F.when(F.col("_p").isNotNull(), F.when(F.col("_p") - a <= b - F.col("_p"), ia).otherwise(ib))
    after_last = (float(ends.low) + period, ends.first) if period else (float(ends.high), ends.last)
    if ends.n <= short:
        rows = sorted((float(r.value), r.idx) for r in axis.select("value", "idx").collect())
        values, ids = [v for v, _ in rows], [i for _, i in rows]
        # Edges at or below the point count, so that a point on a place finds it.
        at = slot_of("_p", values, inclusive=True)
        nth = lambda items, kind: F.expr(f"element_at(array({', '.join(f'{x!r}{'D' if kind == 'double' else 'L'}' for x in items)}), _k)")
        here = keyed.withColumn("_k", F.greatest(at, F.lit(1)))
        out = here.withColumn("idx", pick(nth(values, "double"), nth(ids, "long"), nth([*values[1:], after_last[0]], "double"), nth([*ids[1:], after_last[1]], "long")))
        return out.drop("_p", "_k")

    # As many ranges as keep the session's tasks busy.
    slots = slots or min(256, 4 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    following = axis.select((F.col("idx") - 1).alias("idx"), F.col("value").cast("double").alias("b"), F.col("idx").alias("ib"))
    places = axis.select("idx", F.col("value").cast("double").alias("a")).join(following, "idx", "left")
    places = places.select("a", F.struct("a", F.col("idx").alias("ia"), F.coalesce("b", F.lit(after_last[0])).alias("b"), F.coalesce("ib", F.lit(after_last[1])).alias("ib")).alias("place"))
    both = axis.select(F.col("value").cast("double").alias("x")).unionByName(keyed.select(F.col("_p").alias("x")))
    edges = sorted(set(both.agg(F.percentile_approx("x", [k / slots for k in range(1, slots)], 20 * slots)).first()[0] or []))
    placed = places.withColumn("_slot", slot_of("a", edges))
    dealt = keyed.withColumn("_slot", F.coalesce(slot_of("_p", edges), F.lit(-1)))
    counts = {r[0]: r[1] for r in dealt.groupBy("_slot").count().collect()}  # one number a slot
    each = max(1, 2 * sum(counts.values()) // (len(edges) + 1))
    parts = F.element_at(F.array(*[F.lit(-(-counts.get(s, 0) // each) or 1) for s in range(-1, len(edges) + 1)]), F.col("_slot") + 2)
    # The last place of each slot is handed to the slots after it.
    lasts = {r["_slot"]: r["place"] for r in placed.groupBy("_slot").agg(F.max_by("place", F.struct("a", "place.ia")).alias("place")).collect()}
    handed, held = [], None
    for s in range(len(edges) + 1):
        if held is not None:
            handed.append((held["a"], tuple(held), s))
        held = lasts.get(s, held)
    given = points.sparkSession.createDataFrame(handed, placed.schema)
    spread = placed.unionByName(given).withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    own = dealt.withColumn("_part", F.pmod(F.monotonically_increasing_id(), parts.cast("long")).cast("int"))
    row = F.struct(*[F.col(f"`{c}`") for c in points.columns])
    kind = own.select(row.alias("row")).schema["row"].dataType
    left = spread.select("_slot", "_part", F.col("a").alias("_x"), F.lit(0).alias("_kind"), "place", F.lit(None).cast(kind).alias("row"))
    right = own.select("_slot", "_part", F.col("_p").alias("_x"), F.lit(1).alias("_kind"), F.lit(None).cast(placed.schema["place"].dataType).alias("place"), row.alias("row"))
    before = Window.partitionBy("_slot", "_part").orderBy("_x", "_kind", "place.ia").rowsBetween(Window.unboundedPreceding, 0)
    met = left.unionByName(right).withColumn("_q", F.last("place", ignorenulls=True).over(before)).where("_kind = 1")
    found = met.select("row.*", F.col("_x").alias("_p"), "_q").withColumn("idx", pick(F.col("_q.a"), F.col("_q.ia"), F.col("_q.b"), F.col("_q.ib")))
    return found.drop("_p", "_q")


def irregularity(axis: DataFrame, *keys: str) -> DataFrame:
    """Spread of the steps over their mean; above 0.0005 an axis is irregular."""
    step = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy(*keys).orderBy("idx")))
    steps = axis.withColumn("_s", step).where(F.col("_s") > 1e-7)
    return steps.groupBy(*keys).agg(((F.max("_s") - F.min("_s")) / F.avg("_s")).alias("spread")).withColumn("irregular", F.col("spread") > 0.0005)


def cell_bounds(axis: DataFrame, *keys: str) -> DataFrame:
    """Bounds of each cell: midway to its neighbours, and as far outside at the ends."""
    w = Window.partitionBy(*keys).orderBy("idx")
    v, before, after = F.col("value"), F.lag("value").over(w), F.lead("value").over(w)
    return axis.withColumns({"lo": F.coalesce((before + v) / 2, v - (after - v) / 2, v), "hi": F.coalesce((v + after) / 2, v + (v - before) / 2, v)})


def normal_lon(lon: Column) -> Column:
    return F.when(lon > 180, lon - 360).otherwise(lon)


def regular_cell(lon: Column, lat: Column, width: int, height: int) -> Column:
    """struct<x, y> of a global grid, row 0 in the north; degrees."""
    x = F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * width)
    y = F.floor((90.0 - lat) / 180.0 * height)
    inside = lambda c, n: F.greatest(F.lit(0), F.least(c, F.lit(n - 1))).cast("long")
    return F.struct(inside(x, width).alias("x"), inside(y, height).alias("y"))


def regional_cell(lon: Column, lat: Column, width: int, height: int, west: float, east: float, south: float, north: float) -> Column:
    """struct<x, y> of a grid over a region; null beyond 0.05 radians outside it."""
    slack = math.degrees(0.05)
    turned = F.when((lon < west) & F.lit(east > 180), lon + 360).otherwise(lon)
    inside = turned.between(west - slack, east + slack) & lat.between(south - slack, north + slack)
    place = lambda c, low, high, n: F.greatest(F.lit(0), F.least(F.floor((c - low) / (high - low) * n), F.lit(n - 1))).cast("long")
    y = (height - 1 - place(lat, south, north, height)).cast("long")
    return F.when(inside, F.struct(place(turned, west, east, width).alias("x"), y.alias("y")))


def cell_centre(x: Column, y: Column, width: int, height: int, west: float = -180.0, east: float = 180.0, south: float = -90.0, north: float = 90.0) -> Column:
    """struct<lon, lat> of a cell's centre."""
    return F.struct((west + (x + 0.5) / width * (east - west)).alias("lon"), (north - (y + 0.5) / height * (north - south)).alias("lat"))


def unit_sphere(lon: Column, lat: Column) -> Column:
    """struct<px, py, pz> on the unit sphere, y up; degrees."""
    a, b = F.radians(lon), F.radians(lat)
    return F.struct((F.cos(b) * F.sin(a)).alias("px"), F.sin(b).alias("py"), (F.cos(b) * F.cos(a)).alias("pz"))


def affine_bounds(width: Column, height: Column, x0: Column, y0: Column, dx: Column, dy: Column) -> Column:
    """struct of the corners of a raster with an upper left corner and pixel sizes."""
    return F.struct(x0.alias("west"), (x0 + width * dx).alias("east"), (y0 - height * dy).alias("south"), y0.alias("north"))

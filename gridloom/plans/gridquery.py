"""Registered queries of grids, addresses of stores and catalogues, with their SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from gridloom.functions import fmt, healpix
from gridloom.operators import catalog, grids, vectors
from gridloom.plans import registry, views
from gridloom.plans.registry import NSIDE, _r, query
from gridloom.plans.views import sql
from gridloom.sources import procedural, remote

_NPIX = 12 * NSIDE * NSIDE


# --- DGGS metadata -----------------------------------------------------------------------------------------------------


def _attributed(spark, d):
    """Parts as variables of HEALPix cells, with the metadata written in six ways; a part of size s has 12 s s cells."""
    text = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v if not isinstance(v, str) else F.lit(v))])
    size, way = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    whole = F.concat(F.lit('{"name": "healpix", "refinement_level": '), size, F.lit(', "indexing_scheme": "nested", "spatial_dimension": "face"}'))
    attributes = (
        F.when(way == 0, text(dggs=whole))
        .when(way == 1, text(dggs="HEALPix"))
        .when(way == 2, text(grid_name="HEALPix_sphere", healpix_zoom=size, ordering="NESTED"))
        .when(way == 3, text(healpix_nest="1"))
        .when(way == 4, text(grid_type="a Nested grid", units="K"))
        .otherwise(text(units="K"))
    )
    return views.table(spark, d, "part").select("p_partkey", "p_size", attributes.alias("a"))


@query("""SELECT p_partkey AS pos, CASE p_partkey % 6 WHEN 0 THEN 'healpix' WHEN 1 THEN 'healpix' WHEN 2 THEN 'healpix_sphere' END AS name,
  CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 2 THEN p_size END::BIGINT AS level, CASE p_partkey % 6 WHEN 0 THEN 'face' WHEN 1 THEN '' WHEN 2 THEN 'cells' END AS space,
  CASE WHEN p_partkey % 6 IN (0, 2) AND p_size <= 29 THEN 1::BIGINT << p_size ELSE p_size END::BIGINT AS nside,
  CASE WHEN p_partkey % 6 IN (1, 5) THEN 'ring' ELSE 'nested' END AS ordering, p_partkey % 6 IN (1, 2, 0) AS cells, p_partkey % 6 IN (0, 1) AS faces FROM part""")
def dggs_metadata(spark, d):
    m = grids.dggs(F.col("a"))
    pixels = (F.col("p_size") * F.col("p_size") * 12).cast("long")
    rows = _attributed(spark, d).withColumn("m", m)
    meta = F.col("m")
    return rows.select(
        F.col("p_partkey").alias("pos"), meta["name"].alias("name"), meta["refinement_level"].alias("level"), meta["spatial_dimension"].alias("space"), grids.nside(meta, pixels).alias("nside"),
        grids.ordering(F.col("a"), meta).alias("ordering"), grids.matches_dim(meta, F.lit("cells")).alias("cells"), grids.matches_dim(meta, F.lit("face")).alias("faces"),
    )


# --- grids of axes -----------------------------------------------------------------------------------------------------


def _axes(spark, d):
    """Two axes for every order, of six kinds by its key."""
    o = F.col("o_orderkey")
    way, i = o % 6, F.col("idx")
    place = views.table(spark, d, "orders").select(o.alias("o"), way.alias("w"), F.explode(F.array(F.lit("x"), F.lit("y"))).alias("axis"))
    n = F.when(F.col("w").isin(0, 4), 1).otherwise(10)
    place = place.withColumn("idx", F.explode(F.sequence(F.lit(0), n - 1)))
    x, w = F.col("axis") == "x", F.col("w")
    value = (
        F.when(w == 1, F.when(x, i * 40.0 - 180).otherwise(i * 20.0 - 90))
        .when(w == 2, F.when(x, i * 40.0).otherwise(90 - i * 20.0))
        .when(w == 3, F.when(x, i + i * i * 0.125).otherwise(i * 2.0))
        .when(w == 5, i * 1.0)
    )
    dim = F.when(w == 4, F.when(x, "cell").otherwise("z")).when(w == 5, F.when(x, "a").otherwise("b")).otherwise(F.when(x, "longitude").otherwise("latitude"))
    size = F.when(w == 4, F.when(x, 12 * (F.col("o") % 7 + 1) * (F.col("o") % 7 + 1)).otherwise(1)).otherwise(10).cast("long")
    return place.select("o", "axis", dim.alias("dim"), size.alias("size"), i.alias("idx"), value.cast("double").alias("value"))


_WAY = {
    "kind": "CASE o_orderkey % 6 WHEN 2 THEN 'regional' WHEN 3 THEN 'irregular' WHEN 4 THEN 'healpix' ELSE 'global' END",
    "nside": "CASE WHEN o_orderkey % 6 = 4 THEN o_orderkey % 7 + 1 END",
    "west": "CASE o_orderkey % 6 WHEN 2 THEN 0.0 WHEN 3 THEN 0.0 WHEN 4 THEN 0.0 ELSE -180.0 END::DOUBLE",
    "east": "CASE o_orderkey % 6 WHEN 2 THEN 360.0 WHEN 3 THEN 19.125 WHEN 4 THEN 360.0 ELSE 180.0 END::DOUBLE",
    "south": "CASE o_orderkey % 6 WHEN 3 THEN 0.0 ELSE -90.0 END::DOUBLE",
    "north": "CASE o_orderkey % 6 WHEN 3 THEN 18.0 ELSE 90.0 END::DOUBLE",
    "mode": "CASE o_orderkey % 6 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 5 ELSE 0 END",
    "is_global": "o_orderkey % 6 <> 3",
    "aspect": "CASE WHEN o_orderkey % 6 IN (2, 3) THEN 1.0 ELSE 2.0 END::DOUBLE",
}


def _grids(spark, d):
    return grids.properties(grids.detect(_axes(spark, d), "o"), F.lit(True))


@query("SELECT o_orderkey AS o, " + ", ".join(f"{v} AS {k}" for k, v in _WAY.items()) + " FROM orders")
def grid_detected(spark, d):
    return _grids(spark, d).select("o", *_WAY)


_PX = "-20.0 + p_partkey % 33 + (340 + p_partkey % 21) * (i / 9.0 + p_size * 2e-5 * i * i / 81.0 - p_size * 2e-5 * i / 9.0)"
_PY = "-85.0 + (150 + p_partkey % 20) * (i / 9.0)"


@query(f"""WITH C AS (SELECT p_partkey, unnest(range(0, 10)) AS i, p_size FROM part), A AS (SELECT p_partkey, i, ({_PX.replace('2e-5', '2e-5::DOUBLE').replace('.0', '.0::DOUBLE')})::DOUBLE AS x, ({_PY.replace('.0', '.0::DOUBLE')})::DOUBLE AS y FROM C),
S AS (SELECT *, abs(x - lag(x) OVER w) AS sx, abs(y - lag(y) OVER w) AS sy FROM A WINDOW w AS (PARTITION BY p_partkey ORDER BY i)),
G AS (SELECT p_partkey, min(x) AS west, max(x) AS east, min(y) AS south, max(y) AS north, (max(sx) - min(sx)) / avg(sx) > 0.0005 OR (max(sy) - min(sy)) / avg(sy) > 0.0005 AS uneven FROM S GROUP BY 1),
K AS (SELECT *, p_partkey % 4 < 2 AS named, CASE WHEN uneven THEN 'irregular' WHEN p_partkey % 4 < 2 AND east - west >= 350 AND north - south >= 160 AND west < -5 THEN 'global' WHEN p_partkey % 4 < 3 THEN 'regional' ELSE 'global' END AS kind FROM G)
SELECT p_partkey AS pos, kind, round(CASE kind WHEN 'global' THEN -180 ELSE west END, 6) AS west, round(CASE kind WHEN 'global' THEN 180 ELSE east END, 6) AS east, round(CASE kind WHEN 'global' THEN -90 ELSE south END, 6) AS south,
  round(CASE kind WHEN 'global' THEN 90 ELSE north END, 6) AS north, kind = 'global' OR (east - west >= 350 AND north - south >= 160) AS is_global FROM K""")
def grid_thresholds(spark, d):
    """Axes whose steps, spans and starts lie on both sides of every threshold; the comparison computes steps, spreads and spans itself."""
    both = views.table(spark, d, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
    double = lambda text: text.replace("2e-5", "2e-5D").replace(".0", ".0D")
    both = both.select("p_partkey", "i", F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.expr(double(_PX)).alias("value")), F.struct(F.lit("y").alias("axis"), F.expr(double(_PY)).alias("value")))).alias("a"))
    kind = F.col("p_partkey") % 4
    dim = F.when(kind < 2, F.when(F.col("a.axis") == "x", "lon").otherwise("lat")).when(kind == 2, F.when(F.col("a.axis") == "x", "col").otherwise("b")).otherwise(F.col("a.axis").substr(2, 1))
    axes = both.select("p_partkey", F.col("a.axis").alias("axis"), dim.alias("dim"), F.lit(10).cast("long").alias("size"), F.col("i").alias("idx"), F.col("a.value").alias("value"))
    found = grids.properties(grids.detect(axes, "p_partkey"), F.lit(True))
    return found.select(F.col("p_partkey").alias("pos"), "kind", *[_r(c).alias(c) for c in ("west", "east", "south", "north")], "is_global")


@query("""SELECT a.o_orderkey AS o, b.o_orderkey - a.o_orderkey AS step, CASE WHEN b.o_orderkey - a.o_orderkey = 6 THEN a.o_orderkey % 6 <> 4 ELSE a.o_orderkey % 6 IN (0, 5) END AS same
FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 6 OR b.o_orderkey = a.o_orderkey + 1""")
def grid_same_geometry(spark, d):
    found = _grids(spark, d)
    entry = F.struct("mode", "nside", "west", "east", "south", "north", "xs", "ys")
    left = found.select("o", entry.alias("a"), F.explode(F.array(F.lit(1), F.lit(6))).alias("step")).withColumn("p", F.col("o") + F.col("step"))
    return left.join(found.select(F.col("o").alias("p"), entry.alias("b")), "p").select("o", F.col("step").cast("long").alias("step"), grids.same_geometry(F.col("a"), F.col("b")).alias("same"))


# --- cells by place ----------------------------------------------------------------------------------------------------

_UV = "UV AS (SELECT event_id AS id, (event_id * 37 % 1201 - 100) / 1000.0::DOUBLE AS u, (event_id * 53 % 997) / 997.0::DOUBLE AS v FROM events)"


def _uv(spark, d):
    e = F.col("event_id")
    return views.table(spark, d, "events").select(e.alias("id"), ((e * 37 % 1201 - 100) / 1000.0).alias("u"), (e * 53 % 997 / 997.0).alias("v"))


_CELL = "least(floor(least(greatest(u, 0), 1) * {0}), {0} - 1)::BIGINT AS x, least(floor(least(greatest(v, 0), 1) * {1}), {1} - 1)::BIGINT AS y"


@query(f"WITH {_UV} SELECT id, {_CELL.format(72, 36)} FROM UV")
def cell_of_norm(spark, d):
    return _uv(spark, d).select("id", grids.norm_cell(F.col("u"), F.col("v"), 72, 36).alias("c")).select("id", "c.x", "c.y")


def _pixel_sql(lon: str) -> str:
    return f"WITH {_UV}, P AS (SELECT id, {lon} AS lon, (0.5 - v) * 180 AS lat FROM UV), {registry._A2P} SELECT id, pix FROM HP"


@query(_pixel_sql("((least(greatest(u, 0), 1) * 360 - 180)::DOUBLE + 360) % 360"))
def pixel_of_map(spark, d):
    return _uv(spark, d).select("id", grids.norm_pixel(NSIDE, F.col("u"), F.col("v")).alias("pix"))


@query(_pixel_sql("(least(greatest(u, 0), 1) * 360)::DOUBLE % 360"))
def pixel_of_surface(spark, d):
    return _uv(spark, d).select("id", grids.norm_pixel(NSIDE, F.col("u"), F.col("v"), surface=True).alias("pix"))


@query(sql("E", f", {_UV}, C AS (SELECT id, {_CELL.format(64, 500)} FROM UV) SELECT id, x, y, E.v FROM C LEFT JOIN E USING (x, y)").replace(" , UV", ", UV"))
def value_under_cursor(spark, d):
    cells = views.matrix(spark, d)
    return grids.value_at(_uv(spark, d).withColumnRenamed("v", "w"), cells, F.col("u"), F.col("w"), 64, 500).select("id", "x", "y", "v")


_RAD = f"""RD AS (SELECT id, pix, ring, i, cap, CASE WHEN cap < {NSIDE} THEN (i + 0.5) * pi() / (2 * cap) ELSE (i + CASE WHEN (ring - {NSIDE}) % 2 = 0 THEN 0.5 ELSE 0 END) * pi() / {2 * NSIDE} END AS lon,
  asin(CASE WHEN cap < {NSIDE} THEN CASE WHEN ring < {NSIDE} THEN 1 ELSE -1 END * (1 - cap * cap / {3.0 * NSIDE * NSIDE}) ELSE 2 * ({2 * NSIDE} - ring) / {3.0 * NSIDE} END) AS lat FROM Q2)"""


@query(f"""WITH {registry._H}, {registry._RING}, {_RAD}, T AS (SELECT *, lon / (2 * pi()) AS t, 0.5 - lat / pi() AS v FROM RD)
SELECT id, pix, round(CASE WHEN t > 0.5 THEN t - 0.5 ELSE t + 0.5 END, 6) AS u, round(v, 6) AS v, round((2 * t - 1) * 1.5, 6) AS x, round(2 * v - 1, 6) AS z FROM T""")
def pixel_places(spark, d):
    """Centres of pixels on a map and on a surface."""
    at = F.col("pix")
    rows = registry._pixels(spark, d).withColumns({"m": grids.pixel_centre(NSIDE, at), "s": grids.surface_place(grids.pixel_centre(NSIDE, at, surface=True), 1.5)})
    return rows.select("id", "pix", _r("m.u").alias("u"), _r("m.v").alias("v"), _r("s.x").alias("x"), _r("s.z").alias("z"))


@query("""WITH A AS (SELECT c_nationkey::BIGINT AS g, c_custkey AS idx, c_acctbal::DOUBLE AS value FROM customer), B AS (SELECT g, arg_min(value, idx) AS a, arg_max(value, idx) AS b, count(*) AS n FROM A GROUP BY g)
SELECT g, idx, round(CASE WHEN n = 1 THEN 0.5 ELSE least(greatest((value - a) / CASE WHEN abs(b - a) > 1e-6 THEN b - a ELSE 1 END, 0), 1) END, 6) AS share FROM A JOIN B USING (g)""")
def axis_places(spark, d):
    """How far along its axis each value of an irregular axis is."""
    axis = views.table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("g"), F.col("c_custkey").alias("idx"), F.col("c_acctbal").cast("double").alias("value"))
    return grids.axis_places(axis, "g").select("g", "idx", _r("share").alias("share"))


@query("SELECT s, l, round((l - 0.5) / 7, 6) AS u, round((s % 36 + 0.5) / 36, 6) AS v FROM (SELECT DISTINCT l_suppkey AS s, l_linenumber::BIGINT AS l FROM lineitem)")
def cell_places(spark, d):
    """Centres of cells of a regular grid as shares of its sides."""
    at = views.lines(spark, d).select("s", "l", grids.norm_centre(F.col("l") - 1, F.col("s") % 36, 7, 36).alias("c"))
    return at.select("s", "l", _r("c.u").alias("u"), _r("c.v").alias("v"))


_Z = f"asin(CASE WHEN {{0}} < {NSIDE} THEN 1 - pow({{0}}, 2) / {3.0 * NSIDE * NSIDE} WHEN {{0}} > {3 * NSIDE} THEN pow({4 * NSIDE} - {{0}}, 2) / {3.0 * NSIDE * NSIDE} - 1 ELSE 2 * ({2 * NSIDE} - {{0}}) / {3.0 * NSIDE} END)"
_M = f"least({{0}}, {NSIDE}, {4 * NSIDE} - {{0}})"
_BESIDE = f"round((mid + CASE WHEN {_M.format('({0})')} = 0 THEN 0 ELSE (lon - mid) * {_M.format('ring')} / {_M.format('({0})')} END) % (2 * pi()), 6) % 6.283185::DOUBLE + 0.0"


@query(f"""WITH {registry._H}, {registry._RING}, {_RAD}, W AS (SELECT *, (floor(lon / (pi() / 2)) + 0.5) * pi() / 2 AS mid, pi() / 4 / {_M.format('ring')} AS half FROM RD)
SELECT id, pix, round({_Z.format('(ring - 1)')}, 6) AS top, round({_Z.format('(ring + 1)')}, 6) AS bottom, {_BESIDE.format('ring - 1')} AS top_lon, {_BESIDE.format('ring + 1')} AS bottom_lon,
  round((lon + half) % (2 * pi()), 6) % 6.283185::DOUBLE + 0.0 AS east_lon, round((lon - half + 2 * pi()) % (2 * pi()), 6) % 6.283185::DOUBLE + 0.0 AS west_lon, round(lat, 6) AS lat FROM W""")
def pixel_outlines(spark, d):
    rows = registry._pixels(spark, d).withColumn("c", grids.pixel_outline(NSIDE, F.col("pix")))
    c = lambda k, part: _r(F.get("c", F.lit(k))[part])
    places = {"top": c(0, "lat"), "bottom": c(2, "lat"), "lat": c(1, "lat")}
    turns = {"top_lon": c(0, "lon"), "bottom_lon": c(2, "lon"), "east_lon": c(1, "lon"), "west_lon": c(3, "lon")}
    # A whole turn, rounded, is no turn.
    return rows.select("id", "pix", *[v.alias(k) for k, v in places.items()], *[(v % 6.283185 + 0.0).alias(k) for k, v in turns.items()])


_NEST = f"WITH {registry._H}, {registry._N2R.format(source='H')}"


@query(f"{_NEST}, H2 AS (SELECT id, nest, ring AS pix FROM NR), {registry._RING.replace('FROM H', 'FROM H2')}, {_RAD} SELECT id, H2.nest AS pix, round(lon, 6) AS lon, round(lat, 6) AS lat FROM RD JOIN H2 USING (id)")
def healpix_nested_centre(spark, d):
    at = registry._pixels(spark, d).withColumn("c", healpix.pix2ang_nested(NSIDE, F.col("pix")))
    return at.select("id", "pix", _r("c.lon").alias("lon"), _r("c.lat").alias("lat"))


@query(f"WITH {views.SQL['P']}, {registry._A2P}, AL AS (SELECT 0 AS id, unnest(range(0, {_NPIX})) AS pix), {registry._N2R.format(source='AL')} SELECT HP.id, NR.nest AS pix FROM HP JOIN NR ON NR.ring = HP.pix")
def healpix_nested_pixel(spark, d):
    return views.points(spark, d).select("id", healpix.ang2pix_nested(NSIDE, F.radians("lon"), F.radians("lat")).alias("pix"))


@query(f"""WITH H AS (SELECT pix, sum(value::DECIMAL(18,4))::DOUBLE AS v FROM (SELECT event_id * 7 % {_NPIX} AS pix, value FROM events) GROUP BY 1),
X AS (SELECT pix, v, pix // {NSIDE * NSIDE} AS f, {' + '.join(f'((pix >> {2 * k}) & 1) * {1 << k}' for k in range(4))} AS x, {' + '.join(f'((pix >> {2 * k + 1}) & 1) * {1 << k}' for k in range(4))} AS y FROM H),
C AS (SELECT *, x + a AS cx, y + b AS cy FROM X CROSS JOIN (SELECT unnest([0, 1]) AS a) CROSS JOIN (SELECT unnest([0, 1]) AS b))
SELECT pix, a::BIGINT AS corner_x, b::BIGINT AS corner_y, round(avg(v) OVER (PARTITION BY f, cx, cy), 6) AS v FROM C""")
def healpix_corner_means(spark, d):
    at = views.table(spark, d, "events").groupBy((F.col("event_id") * 7 % _NPIX).alias("pix")).agg(F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("v"))
    return grids.corner_means(at, NSIDE).withColumn("v", _r("v"))


@query(f"""WITH {registry._H}, {registry._RING}, {_RAD}, T AS (SELECT id, pix, lon, lat, id % 24 * 0.3 AS ph, id % 8 * 6.5 AS decay FROM RD)
SELECT id, pix, round(285 + 35 * cos(lat) - 15 * pow(sin(lat), 2) + 18 * cos(4 * lon - ph) * pow(cos(lat), 2) * sin(2 * lat) - decay, 5) AS temp, round(1013.25 + 25 * cos(4 * lon - ph) * pow(cos(lat), 2) - 15 * sin(lat), 5) AS mslp FROM T""")
def healpix_fields(spark, d):
    at = registry._pixels(spark, d).withColumn("c", healpix.pix2ang(NSIDE, F.col("pix")))
    lon, lat, t = F.col("c.lon"), F.col("c.lat"), F.col("id") % 24
    return at.select("id", "pix", _r(procedural.sphere_temperature(lon, lat, t, F.col("id") % 8), 5).alias("temp"), _r(procedural.sphere_pressure(lon, lat, t), 5).alias("mslp"))


# --- variables, names and addresses ------------------------------------------------------------------------------------


@query("""SELECT p_partkey AS pos, p_size % 3 <> 0 AND p_size % 5 >= 3 AS rgb, CASE WHEN p_size % 3 <> 0 THEN p_size % 5 ELSE 3 END::BIGINT AS bands, p_partkey % 4 = 0 OR p_partkey % 7 = 0 OR p_partkey % 9 = 0 AS cmyk FROM part""")
def band_facts(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    shape = F.when(s % 3 != 0, F.array(s % 5, F.lit(10).cast("long"), F.lit(10).cast("long"))).otherwise(F.array(s, F.lit(10).cast("long")))
    attributes = F.when(k % 4 == 0, F.create_map(F.lit("photometric"), F.lit("CMYK"))).when(k % 7 == 0, F.create_map(F.lit("color_space"), F.lit("cmyk")))
    name = F.when(k % 9 == 0, F.concat("p_name", F.lit(" (CMYK)"))).otherwise(F.col("p_name"))
    return views.table(spark, d, "part").select(k.alias("pos"), grids.band_facts(shape, attributes, name).alias("f")).select("pos", "f.rgb", "f.bands", "f.cmyk")


@query("""SELECT l_suppkey AS s, CASE WHEN l_suppkey % 3 = 0 THEN min(l_quantity) WHEN l_suppkey % 3 = 1 THEN min(l_discount) ELSE 0 END::DOUBLE AS lo, CASE WHEN l_suppkey % 3 = 0 THEN max(l_quantity) WHEN l_suppkey % 3 = 1 THEN max(l_tax) ELSE 1 END::DOUBLE AS hi FROM lineitem GROUP BY 1""")
def bounds_policy(spark, d):
    q, k = F.col("l_quantity"), F.col("l_suppkey")
    per = views.table(spark, d, "lineitem").groupBy(k).agg(F.struct(F.min(q).alias("lo"), F.max(q).alias("hi")).alias("own"), F.min("l_discount").alias("low"), F.max("l_tax").alias("high"))
    block = F.struct(F.when(k % 3 == 2, float("nan")).otherwise(F.col("low")).alias("lo"), F.col("high").alias("hi"))
    return per.select(k.alias("s"), grids.chosen_bounds(k % 3 == 0, F.col("own"), block).alias("b")).select("s", "b.lo", "b.hi")


@query("""WITH A AS (SELECT p_partkey AS pos, ltrim('/v' || p_partkey, '/') AS name, lower(p_type) AS t, lower(p_brand) AS b, p_partkey % 3 AS w FROM part),
N AS (SELECT 1 AS step, pos, 0 AS place, name FROM A WHERE w = 0 UNION ALL SELECT 2, pos, 0, t FROM A WHERE w <> 0 UNION ALL SELECT 2, pos, 1, b FROM A WHERE w <> 0 UNION ALL SELECT 2, pos, 0, b FROM A WHERE w = 0
UNION ALL SELECT 2, pos, 2, 'cell_ids' FROM A WHERE w = 1 UNION ALL SELECT 3, 0, k, ['lat', 'latitude', 'y', 'lon', 'longitude', 'x', 'time', 'depth', 'lev', 'level', 'height'][k + 1] FROM (SELECT unnest(range(0, 11)) AS k))
SELECT name AS candidate, row_number() OVER (ORDER BY min(row(step, pos, place)))::INT AS rank FROM N WHERE name <> '' GROUP BY name""")
def coordinate_names(spark, d):
    k, low = F.col("p_partkey"), lambda c: F.concat(F.lit(" /"), F.lower(c))
    single = k % 3 == 0
    shape = F.when(single, F.array(F.lit(5).cast("long"))).otherwise(F.array(F.lit(5).cast("long"), F.lit(7).cast("long")))
    dims = F.when(single, F.array(low("p_brand"))).otherwise(F.array(low("p_type"), low("p_brand")))
    attributes = F.when(k % 3 == 1, F.create_map(F.lit("grid_name"), F.lit("healpix"), F.lit("coordinate"), F.lit("cell_ids"))).otherwise(F.create_map(F.lit("units"), F.lit("K")))
    rows = views.table(spark, d, "part").select(k.alias("pos"), F.concat(F.lit("/v"), k.cast("string")).alias("name"), shape.alias("shape"), dims.alias("dims"), attributes.alias("attributes"))
    return grids.coordinate_candidates(rows)


_URL = "U AS (SELECT c_custkey AS id, c_custkey % 7 AS w, 'b' || (c_custkey % 50) AS b, 'n' || c_nationkey || '/k' || c_custkey AS k FROM customer)"


def _addresses(spark, d):
    c, w = F.col("c_custkey"), F.col("c_custkey") % 7
    b, k = F.concat(F.lit("b"), (c % 50).cast("string")), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("/k"), c.cast("string"))
    url = (
        F.when(w == 0, F.concat(F.lit("s3://"), b, F.lit("/"), k))
        .when(w == 1, F.concat(F.lit("icechunk+vcc://"), b))
        .when(w == 2, F.concat(F.lit("https://"), b, F.lit(".s3.eu-west-1.amazonaws.com/"), k))
        .when(w == 3, F.concat(F.lit("https://"), b, F.lit(".s3-us-west-2.amazonaws.com")))
        .when(w == 4, F.concat(F.lit("https://data.source.coop/"), b, F.lit("/"), k))
        .when(w == 5, F.concat(F.lit(" http://host:9000/"), b, F.lit("//"), k))
        .otherwise(F.lit("s3://"))
    )
    return views.table(spark, d, "customer").select(c.alias("id"), url.alias("url"))


@query(f"""WITH {_URL} SELECT id, CASE WHEN w < 6 THEN b END AS bucket, CASE WHEN w IN (0, 2, 4, 5) THEN k END AS prefix, CASE w WHEN 2 THEN 'eu-west-1' WHEN 3 THEN 'us-west-2' WHEN 6 THEN NULL ELSE 'us-east-1' END AS region,
  CASE w WHEN 4 THEN 'https://data.source.coop' WHEN 5 THEN 'http://host:9000' END AS endpoint, CASE WHEN w < 6 THEN w IN (4, 5) END AS path_style,
  CASE w WHEN 0 THEN 'https://' || b || '.s3.amazonaws.com/' || k WHEN 1 THEN 'https://' || b || '.s3.amazonaws.com' WHEN 2 THEN 'https://' || b || '.s3.eu-west-1.amazonaws.com/' || k WHEN 3 THEN 'https://' || b || '.s3-us-west-2.amazonaws.com'
    WHEN 4 THEN 'https://data.source.coop/' || b || '/' || k WHEN 5 THEN 'http://host:9000/' || b || '//' || k ELSE 'https://.s3.amazonaws.com' END AS web FROM U""")
def store_addresses(spark, d):
    rows = _addresses(spark, d).select("id", remote.parse(F.col("url")).alias("p"), remote.to_https(F.col("url")).alias("web"))
    return rows.select("id", "p.bucket", "p.prefix", "p.region", "p.endpoint", "p.path_style", "web")


@query("""WITH K AS (SELECT c_custkey AS id, ['local_zarr', 'remote_zarr', 'local_netcdf', NULL][c_custkey % 4 + 1] AS a, ['remote_icechunk', 'local_geotiff', 'local_icechunk', 'remote_zarr', NULL][c_custkey % 5 + 1] AS b FROM customer)
SELECT id, CASE WHEN a IS NULL THEN coalesce(b, 'procedural') WHEN a = 'local_zarr' AND b IN ('local_geotiff', 'local_icechunk') THEN b WHEN a = 'remote_zarr' AND b IN ('remote_icechunk', 'local_geotiff') THEN b ELSE a END AS kind FROM K""")
def store_kinds(spark, d):
    c = F.col("c_custkey")
    pick = lambda names: F.get(F.array(*[F.lit(n).cast("string") for n in names]), (c % len(names)).cast("int"))
    return views.table(spark, d, "customer").select(c.alias("id"), remote.resolve_kind(pick(["local_zarr", "remote_zarr", "local_netcdf", None]), pick(["remote_icechunk", "local_geotiff", "local_icechunk", "remote_zarr", None]), F.lit("procedural")).alias("kind"))


@query(sql("B", "SELECT source, variable, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM B GROUP BY GROUPING SETS ((source), (variable))"))
def bytes_by_key(spark, d):
    return catalog.bytes_by(views.blocks(spark, d), "source", "variable")


@query("SELECT p_partkey AS id, p_name AS title, NULL AS place, 'parts' AS catalog FROM part UNION ALL SELECT s_suppkey, s_name, s_nationkey::VARCHAR, 'suppliers' FROM supplier UNION ALL SELECT c_custkey, c_name, c_nationkey::VARCHAR, 'customers' FROM customer UNION ALL SELECT n_nationkey, n_name, n_regionkey::VARCHAR, 'nations' FROM nation")
def all_catalogs(spark, d):
    t = lambda name, key, title, place=None: views.table(spark, d, name).select(F.col(key).cast("long").alias("id"), F.col(title).alias("title"), *([F.col(place).cast("string").alias("place")] if place else []))
    lists = {"parts": t("part", "p_partkey", "p_name"), "suppliers": t("supplier", "s_suppkey", "s_name", "s_nationkey"), "customers": t("customer", "c_custkey", "c_name", "c_nationkey"), "nations": t("nation", "n_nationkey", "n_name", "n_regionkey")}
    return catalog.union_catalogs(lists, ["id", "title", "place"])


@query("SELECT user_id, min(event_id) FILTER (event_type = 'purchase') AS first FROM events GROUP BY 1")
def first_purchase(spark, d):
    return catalog.first_match(views.table(spark, d, "events"), ["user_id"], "event_id", F.col("event_type") == "purchase", F.col("event_id"))


@query(f"WITH {registry._VERT} SELECT line, i, round(lon1, 6) AS lon1, round(lat1, 6) AS lat1, round(lon2, 6) AS lon2, round(lat2, 6) AS lat2 FROM SG WHERE lon1 BETWEEN -120 AND 100 AND lon2 BETWEEN -120 AND 100 AND lat1 BETWEEN -60 AND 70 AND lat2 BETWEEN -60 AND 70")
def polyline_crop(spark, d):
    return registry._rounded(vectors.crop(vectors.segments(registry._vertices(spark, d), "line", "i"), -120, 100, -60, 70))


_LABELS = ["lon", "Latitude", "depth", "plev", "cell"]


@query(sql("P", f"""SELECT id, {_LABELS}[id % 5 + 1] || ':' || chr(160) || CASE id % 5 WHEN 0 THEN printf('%.2f', abs(lat)) || CASE WHEN lat >= 0 THEN '°E' ELSE '°W' END WHEN 1 THEN printf('%.2f', abs(lat)) || CASE WHEN lat >= 0 THEN '°N' ELSE '°S' END
  WHEN 2 THEN printf('%.2f', lat) || chr(160) || 'm' WHEN 3 THEN printf('%.2f', lat) || chr(160) || 'hPa' ELSE printf('%.2f', lat) END AS label FROM (SELECT id, round(lat, 1) AS lat FROM P)"""))
def coordinate_labels(spark, d):
    dim = F.get(F.array(*map(F.lit, _LABELS)), (F.col("id") % 5).cast("int"))
    return views.points(spark, d).select("id", fmt.coordinate_label(dim, F.round("lat", 1)).alias("label"))

"""Registered queries of the lookups between tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.operators import coords, reduce, relate, stencil, vectors
from gridloom.plans import views
from gridloom.plans.registry import query
from gridloom.plans.views import sql


@query(sql("V", "SELECT d, h, k, v FROM V WHERE 2 * d + h - k >= 12 AND -d + h >= -20"))
def clip_planes(spark, d):
    return relate.clip(views.volume(spark, d), [({"d": 2, "h": 1, "k": -1}, 12), ({"d": -1, "h": 1}, -20)])


_NAMES = """DEF AS (SELECT r_name || '/' || n_name AS key, 'scoped ' || n_nationkey AS value FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0
  UNION ALL SELECT n_name, 'plain ' || n_nationkey FROM nation WHERE n_nationkey % 3 = 0)"""


@query(f"WITH {_NAMES} SELECT s_suppkey AS s, coalesce(a.value, b.value, n_name) AS resolved FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN DEF a ON a.key = r_name || '/' || n_name LEFT JOIN DEF b ON b.key = n_name")
def scoped_names(spark, d):
    nation = views.table(spark, d, "nation").join(views.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    definitions = nation.where("n_nationkey % 2 = 0").select(F.concat_ws("/", "r_name", "n_name").alias("key"), F.concat(F.lit("scoped "), "n_nationkey").alias("value"))
    definitions = definitions.unionByName(nation.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("key"), F.concat(F.lit("plain "), "n_nationkey").alias("value")))
    rows = views.table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return relate.resolve_names(rows, definitions, "r_name", "n_name", "resolved").select(F.col("s_suppkey").alias("s"), "resolved")


@query("""SELECT p_partkey AS chunk, b.o AS snapshot, b.n AS place FROM part LEFT JOIN
  (SELECT l_partkey, l_orderkey AS o, l_linenumber::BIGINT AS n, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber) AS r FROM lineitem) b ON p_partkey = l_partkey AND r = 1""")
def manifest_chunks(spark, d):
    """A part is a chunk, a line item a manifest entry, its order the snapshot that wrote it: the last snapshot holds."""
    chunks = views.table(spark, d, "part").select(F.col("p_partkey").alias("chunk"))
    entries = views.table(spark, d, "lineitem").select(F.col("l_partkey").alias("chunk"), "l_orderkey", F.col("l_linenumber").cast("long").alias("n"))
    found = relate.manifest_entries(chunks, entries, ["chunk"], [F.col("l_orderkey"), -F.col("n")], F.struct(F.col("l_orderkey").alias("o"), "n"))
    return found.select("chunk", F.col("entry.o").alias("snapshot"), F.col("entry.n").alias("place"))


@query(sql("V", "SELECT d, h, k FROM (SELECT d, h, k, row_number() OVER (PARTITION BY d, h ORDER BY CASE WHEN v IS NULL THEN 'inf'::DOUBLE ELSE abs(v - 150) END, k) AS r FROM V) WHERE r = 1"))
def nearest_series(spark, d):
    return relate.nearest_series(views.volume(spark, d), ["d", "h"], "k", "v", F.lit(150.0))


@query(sql("R", "SELECT source, variable, step // 8 * 8 AS start, list_sort(list(DISTINCT step)) AS steps, count(*) AS requests FROM R GROUP BY 1, 2, 3"))
def fetch_groups(spark, d):
    return relate.fetch_groups(views.requests(spark, d), ["source", "variable"], "step", 8)


@query("SELECT user_id, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1")
def batch_outcomes(spark, d):
    return relate.outcome_counts(views.table(spark, d, "events"), ["user_id"], F.col("event_type") != "error")


@query(sql("B", "SELECT source, variable, min(start) AS first_step FROM B GROUP BY 1, 2"))
def first_resident_step(spark, d):
    return relate.first_resident_step(views.blocks(spark, d), ["source", "variable"])


@query(sql("VAR", "SELECT grp, min(pos) AS first FROM VAR GROUP BY 1"))
def ordered_groups(spark, d):
    rows = views.variables(spark, d).withColumn("grp", F.regexp_extract("name", "^(.*)/[^/]*$", 1))
    return relate.ordered_distinct(rows, "grp", "pos")


@query("SELECT l_orderkey AS o, list(l_linenumber::BIGINT ORDER BY l_linenumber) = range(1, count(*) + 1) AS same FROM lineitem GROUP BY 1")
def compatible_shapes(spark, d):
    rows = views.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.sort_array(F.collect_list(F.col("l_linenumber").cast("long"))).alias("a"))
    return rows.select("o", relate.compatible(F.col("a"), F.sequence(F.lit(1).cast("long"), F.size("a").cast("long"))).alias("same"))


@query(sql("VAR", "SELECT pos, CASE WHEN units IS NOT NULL THEN name || ' (' || units || ')' ELSE name END AS label FROM VAR"))
def variable_labels(spark, d):
    return views.variables(spark, d).select("pos", relate.variable_label(F.col("name"), F.col("units")).alias("label"))


@query("""WITH A AS (SELECT o_orderkey AS o, o_orderkey % 90 AS a, o_custkey % 90 AS b FROM orders)
SELECT o, round(least(-90 + least(a, b) / 89.0 * 180, -90 + greatest(a, b) / 89.0 * 180), 6) AS low, round(greatest(-90 + least(a, b) / 89.0 * 180, -90 + greatest(a, b) / 89.0 * 180), 6) AS high FROM A""")
def range_bounds(spark, d):
    o = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("o"), (F.col("o_orderkey") % 90).alias("a"), (F.col("o_custkey") % 90).alias("b"))
    c = relate.range_bounds(F.lit(-90.0), F.lit(90.0), F.lit(90), F.col("a"), F.col("b"))
    return o.select("o", c.alias("c")).select("o", F.round("c.low", 6).alias("low"), F.round("c.high", 6).alias("high"))


@query("SELECT event_id AS id, round(CASE WHEN u < 0.5 THEN 4 * u * u * u ELSE 1 - pow(2 - 2 * u, 3) / 2 END, 6) AS eased FROM (SELECT event_id, least(greatest(value / 200, 0), 1) AS u FROM events)")
def eased(spark, d):
    return views.table(spark, d, "events").select(F.col("event_id").alias("id"), F.round(relate.ease(F.col("value") / 200), 6).alias("eased"))


_O = "(SELECT unnest([-1, 0, 1]) AS {0})"


@query(sql("V", f"""SELECT T.d, T.h, T.k, round(sum(-i * (CASE j WHEN 0 THEN 2 ELSE 1 END) * (CASE l WHEN 0 THEN 2 ELSE 1 END) * coalesce(N.v, 0)), 4) AS g_d,
  round(sum(-j * (CASE i WHEN 0 THEN 2 ELSE 1 END) * (CASE l WHEN 0 THEN 2 ELSE 1 END) * coalesce(N.v, 0)), 4) AS g_h, round(sum(-l * (CASE i WHEN 0 THEN 2 ELSE 1 END) * (CASE j WHEN 0 THEN 2 ELSE 1 END) * coalesce(N.v, 0)), 4) AS g_k
  FROM V T CROSS JOIN {_O.format('i')} CROSS JOIN {_O.format('j')} CROSS JOIN {_O.format('l')} CROSS JOIN V_N JOIN V N ON N.d = least(greatest(T.d + i, 0), days - 1) AND N.h = least(greatest(T.h + j, 0), 23) AND N.k = least(greatest(T.k + l, 0), kinds - 1) GROUP BY 1, 2, 3"""))
def sobel_gradient(spark, d):
    """The volume in chunks of 8 days, 10 hours and 3 types; chunks exchange their border layers only."""
    axes, sizes = views.volume_shape(spark, d), {"d": 8, "h": 10, "k": 3}
    chunks = stencil.to_chunks(views.volume(spark, d), axes, sizes)
    g = stencil.to_cells(stencil.gradient(chunks, {c: -(-n // sizes[c]) for c, n in axes.items()}, sizes), ["d", "h", "k"], ["g_d", "g_h", "g_k"])
    return g.select("d", "h", "k", *[(F.round(c, 4) + 0.0).alias(c) for c in ("g_d", "g_h", "g_k")])


_AXIS = """A AS (SELECT row_number() OVER (ORDER BY value) - 1 AS idx, value FROM (SELECT DISTINCT CASE WHEN s_suppkey % 1000 = 1 THEN 1e9 ELSE s_acctbal END AS value FROM supplier)),
NB AS (SELECT idx, value AS a, coalesce(lead(value) OVER (ORDER BY idx), value) AS b, coalesce(lead(idx) OVER (ORDER BY idx), idx) AS nxt FROM A)"""


@query(f"""WITH {_AXIS}, O AS (SELECT o_orderkey AS id, o_totalprice / 20 - 3000 AS p FROM orders),
Q AS (SELECT id, greatest(least(p, (SELECT max(value) FROM A)), (SELECT min(value) FROM A)) AS p FROM O)
SELECT id, CASE WHEN p - a <= b - p THEN idx ELSE nxt END AS idx FROM Q ASOF JOIN NB ON p >= a""")
def nearest_sorted(spark, d):
    """Orders on the axis of the suppliers' balances, which has an outlier at 10^9: both sides in sorted ranges."""
    s = views.table(spark, d, "supplier")
    places = s.select(F.when(F.col("s_suppkey") % 1000 == 1, 1e9).otherwise(F.col("s_acctbal")).alias("value")).distinct()
    axis = coords.numbered(places, "value")
    points = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 20 - 3000).alias("p"))
    return coords.nearest(points, "p", axis, short=0).select("id", "idx")


@query("""WITH A AS (SELECT i AS idx, i * i / 100.0::DOUBLE AS value FROM (SELECT unnest(range(0, 189)) AS i)), P AS (SELECT event_id AS id, (event_id * 37 % 7200) / 10.0::DOUBLE - 360 AS lon FROM events),
Q AS (SELECT id, lon - 360 * floor(lon / 360) AS lon FROM P), M AS (SELECT id, lon, max(idx) AS i FROM Q JOIN A ON value <= lon GROUP BY 1, 2)
SELECT id, CASE WHEN lon - a.value <= coalesce(b.value, 360) - lon THEN i ELSE coalesce(b.idx, 0) END AS idx FROM M JOIN A a ON a.idx = i LEFT JOIN A b ON b.idx = i + 1""")
def nearest_turned(spark, d):
    """Longitudes from -360 to 360 on an irregular axis that goes round at 360."""
    axis = spark.range(189).select(F.col("id").alias("idx"), (F.col("id") * F.col("id") / 100.0).alias("value"))
    e = F.col("event_id")
    points = views.table(spark, d, "events").select(e.alias("id"), ((e * 37 % 7200) / 10.0 - 360).alias("lon"))
    return coords.nearest(points, "lon", axis, period=360.0).select("id", "idx")


@query(
    sql("V", "").rstrip()
    + """, S AS (SELECT h, k, row_number() OVER (PARTITION BY h, k ORDER BY d) AS i, least(greatest(v / 400, 0), 1) AS u FROM V WHERE v IS NOT NULL),
R AS (SELECT h, k, i, u, 1 - least(u * 1.2, 0.95) AS through FROM S),
L AS (SELECT h, k, u, 1 - through AS a, coalesce(product(through) OVER (PARTITION BY h, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS t FROM R)
SELECT h, k, round(sum(t * a * u), 6) AS red, round(sum(t * a * (1 - u)), 6) AS green, round(sum(t * a * u * u), 6) AS blue, round(sum(t * a), 6) AS alpha FROM L GROUP BY h, k"""
)
def composite_rays(spark, d):
    """Colour and opacity of each ray along the days, in slabs of a week."""
    u = F.least(F.greatest(F.col("v") / 400, F.lit(0.0)), F.lit(1.0))
    rays = reduce.composite(views.volume(spark, d), "d", ["h", "k"], {"red": u, "green": 1 - u, "blue": u * u}, F.least(u * 1.2, F.lit(0.95)), 7)
    return rays.select("h", "k", *[F.round(c, 6).alias(c) for c in ("red", "green", "blue", "alpha")])


_TRACK = "TR AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, (event_id * 37 % 3600) / 10.0::DOUBLE - 180 AS lon, (event_id * 53 % 1799) / 10.0::DOUBLE - 89.9 AS lat FROM events)"


def _tracks(spark, d):
    """A GeoJSON text for each user: the places of their events as one line, or as lines of ten for every third user."""
    e = F.col("event_id")
    place = F.array((e * 37 % 3600) / 10.0 - 180, (e * 53 % 1799) / 10.0 - 89.9)
    path = F.transform(F.array_sort(F.collect_list(F.struct("event_id", place.alias("p")))), lambda s: s["p"])
    users = views.table(spark, d, "events").groupBy("user_id").agg(path.alias("path"))
    tens = F.transform(F.sequence(F.lit(0), F.floor((F.size("path") - 1) / 10).cast("int")), lambda k: F.slice("path", k * 10 + 1, 10))
    many = F.col("user_id") % 3 == 0
    coordinates = F.when(many, F.to_json(tens)).otherwise(F.to_json("path"))
    feature = F.concat(F.lit('{"type": "Feature", "geometry": {"type": "'), F.when(many, "MultiLineString").otherwise("LineString"), F.lit('", "coordinates": '), coordinates, F.lit('}, "properties": {"scalerank": 1}}'))
    other = F.lit('{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}}, {"type": "Feature", "geometry": null}, ')
    return users.select("user_id", F.when(F.col("user_id") % 2 == 0, feature).otherwise(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), other, feature, F.lit("]}"))).alias("text"))


@query(f"WITH {_TRACK} SELECT user_id, (CASE WHEN user_id % 2 = 0 THEN 0 ELSE 2 END)::INTEGER AS feature, (CASE WHEN user_id % 3 = 0 THEN pos // 10 ELSE 0 END)::INTEGER AS part, (CASE WHEN user_id % 3 = 0 THEN pos % 10 ELSE pos END)::INTEGER AS pos, round(lon, 6) AS lon, round(lat, 6) AS lat FROM TR")
def geojson_vertices(spark, d):
    v = vectors.geojson_vertices(_tracks(spark, d), "text", "user_id")
    return v.select("user_id", "feature", "part", "pos", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(f"""WITH {_TRACK}, SG AS (SELECT user_id, pos, lon AS x, lat AS y, lead(lon) OVER w - lon AS dx, lead(lat) OVER w - lat AS dy FROM TR WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
T AS (SELECT *, greatest(0, least((-60 - x) / dx, (75 - x) / dx), least((-30 - y) / dy, (45 - y) / dy)) AS t0, least(1, greatest((-60 - x) / dx, (75 - x) / dx), greatest((-30 - y) / dy, (45 - y) / dy)) AS t1 FROM SG WHERE dx <> 0 AND dy <> 0
  UNION ALL SELECT *, greatest(0, least((-30 - y) / dy, (45 - y) / dy)), least(1, greatest((-30 - y) / dy, (45 - y) / dy)) FROM SG WHERE dx = 0 AND dy <> 0 AND x BETWEEN -60 AND 75
  UNION ALL SELECT *, greatest(0, least((-60 - x) / dx, (75 - x) / dx)), least(1, greatest((-60 - x) / dx, (75 - x) / dx)) FROM SG WHERE dy = 0 AND dx <> 0 AND y BETWEEN -30 AND 45)
SELECT user_id, pos, round(x + t0 * dx, 6) + 0.0 AS lon1, round(y + t0 * dy, 6) + 0.0 AS lat1, round(x + t1 * dx, 6) + 0.0 AS lon2, round(y + t1 * dy, 6) + 0.0 AS lat2 FROM T WHERE t0 < t1""")
def polyline_cut(spark, d):
    """The users' tracks inside a box, their segments cut at its edge."""
    e = F.col("event_id")
    track = views.table(spark, d, "events").select("user_id", "event_id", ((e * 37 % 3600) / 10.0 - 180).alias("lon"), ((e * 53 % 1799) / 10.0 - 89.9).alias("lat"))
    numbered = track.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long") - 1)
    parts = vectors.cut(vectors.segments(numbered, "user_id", "pos"), -60.0, 75.0, -30.0, 45.0)
    return parts.select("user_id", "pos", *[(F.round(c, 6) + 0.0).alias(c) for c in ("lon1", "lat1", "lon2", "lat2")])

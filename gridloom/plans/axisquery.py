"""Registered queries of axis dates and labels, ticks, grids with metadata, trees of variables and palettes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import axes, scale
from gridloom.operators import catalog, grids, relate
from gridloom.operators.select import Range
from gridloom.plans import views
from gridloom.plans.gridquery import _attributed
from gridloom.plans.registry import _r, query
from gridloom.plans.views import sql
from gridloom.sources import procedural

# --- axes of dates -----------------------------------------------------------------------------------------------------

_DIMS = ["time", "Date_utc", "lat", None, "band"]
_RESOLUTIONS = ["8D", "16 days", "1 day", "3DAYS", " 5d ", "monthly", None]
_ADDRESSES = ["s3://b/cube-16D", "x/daily.zarr", "seasfire_cube", "s3://b/other", None, "v/8d"]
_list = lambda names: "[" + ", ".join("NULL" if n is None else f"'{n}'" for n in names) + "]"

_AXES = f"""A AS (SELECT o_orderkey AS id, o_orderkey % 500 AS step, strftime(o_orderdate, '%Y-%m-%d') AS day, {_list(_DIMS)}[o_custkey % 5 + 1] AS dim, {_list(_RESOLUTIONS)}[o_orderkey % 7 + 1] AS res,
  {_list(_ADDRESSES)}[o_orderkey % 6 + 1] AS addr, o_custkey % 3 AS u, o_orderkey // 3 % 3 AS w FROM orders),
B AS (SELECT *, CASE u WHEN 0 THEN 'Days since ' || day || ' 00:00' WHEN 1 THEN 'hours since ' || day || 'T06:00:00' ELSE 'K' END AS units, CASE w WHEN 0 THEN day || 'T12:00:00Z' WHEN 1 THEN 'unknown' END AS start FROM A),
C AS (SELECT *, CASE WHEN res = '8D' THEN 8 WHEN res IN ('16 days') THEN 16 WHEN res IN ('1 day', '3DAYS') THEN 1 WHEN res = ' 5d ' THEN 5 WHEN res = 'monthly' THEN 8
  WHEN contains(lower(addr), '16d') THEN 16 WHEN contains(lower(addr), '8d') OR contains(addr, 'seasfire') THEN 8 WHEN contains(addr, 'daily') THEN 1 ELSE 8 END AS days FROM B),
D AS (SELECT *, (CASE WHEN start LIKE '____-%' THEN start[1:10] WHEN units LIKE '% since %' THEN regexp_extract(units, '([0-9-]{{10}})', 1) WHEN contains(addr, 'seasfire') THEN '2001-01-01' ELSE '1979-01-01' END)::DATE AS first,
  CASE WHEN coalesce(start, '') NOT LIKE '____-%' AND units LIKE 'Days since %' THEN 1 ELSE days END AS each FROM C)"""


def _dated(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda names, at: F.get(F.array(*[F.lit(n).cast("string") for n in names]), (at % len(names)).cast("int"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    w = F.floor(k / 3) % 3
    return views.table(spark, d, "orders").select(
        k.alias("id"), (k % 500).alias("step"), F.to_date("o_orderdate").alias("day"), pick(_DIMS, c).alias("dim"), pick(_RESOLUTIONS, k).alias("res"), pick(_ADDRESSES, k).alias("addr"),
        F.when(c % 3 == 0, F.concat(F.lit("Days since "), day, F.lit(" 00:00"))).when(c % 3 == 1, F.concat(F.lit("hours since "), day, F.lit("T06:00:00"))).otherwise("K").alias("units"),
        F.when(w == 0, F.concat(day, F.lit("T12:00:00Z"))).when(w == 1, "unknown").alias("start"),
    )


@query(f"""WITH {_AXES} SELECT id, CASE WHEN coalesce(dim, 'time') IN ('time', 'Date_utc') OR units LIKE '% since %' THEN strftime(first + (step * each)::INT, '%Y-%m-%d') ELSE 'Step ' || (step + 1) || ' / 500' END AS label FROM D""")
def axis_labels(spark, d):
    c = F.col
    return _dated(spark, d).select("id", axes.axis_label(c("step"), F.lit(500), c("dim"), c("units"), c("start"), c("res"), c("addr")).alias("label"))


@query(f"WITH {_AXES} SELECT id, first, each::INT AS each, floor(date_diff('day', first, day::DATE) / each)::BIGINT AS held FROM D")
def axis_references(spark, d):
    """The date of step 0, the days of a step, and the step that holds the date of the order."""
    c = F.col
    at = _dated(spark, d).withColumn("at", axes.reference(c("units"), c("start"), c("res"), c("addr")))
    return at.select("id", c("at.day").alias("first"), c("at.days").alias("each"), axes.date_step(c("day"), c("at")).alias("held"))


_BARS = "B AS (SELECT l_orderkey AS bar, min(l_extendedprice)::DOUBLE AS lo, max(l_extendedprice)::DOUBLE AS hi FROM lineitem GROUP BY 1)"


def _bars(spark, d):
    return views.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("bar")).agg(F.min("l_extendedprice").cast("double").alias("lo"), F.max("l_extendedprice").cast("double").alias("hi"))


@query(f"""WITH {_BARS}, R AS (SELECT bar, lo, greatest(hi, lo * 1.0001) AS hi, log10(lo) AS a, log10(greatest(hi, lo * 1.0001)) AS b FROM B),
M AS (SELECT *, m * pow(10, e) AS v FROM R, (SELECT unnest(range(1, 10)) AS m), (SELECT unnest(range(-1, 9)) AS e) WHERE b - a >= 0.8),
T AS (SELECT bar, greatest(least((log10(v) - a) / (b - a), 1), 0) AS "at", v AS value, m = 1 AS major FROM M WHERE CASE WHEN m = 1 THEN v BETWEEN lo * 0.999 AND hi * 1.001 ELSE v > lo AND v < hi END),
Z AS (SELECT * FROM T UNION ALL SELECT bar, 0, lo, true FROM R WHERE b - a >= 0.8 AND NOT EXISTS (SELECT 1 FROM T WHERE T.bar = R.bar AND T."at" < 0.02)
UNION ALL SELECT bar, 1, hi, true FROM R WHERE b - a >= 0.8 AND NOT EXISTS (SELECT 1 FROM T WHERE T.bar = R.bar AND T."at" > 0.98)
UNION ALL SELECT bar, k / 20.0::DOUBLE, exp(ln(lo) + k / 20.0::DOUBLE * (ln(hi) - ln(lo))), k % 5 = 0 FROM R, (SELECT unnest(range(0, 21)) AS k) WHERE b - a < 0.8)
SELECT bar, round(Z."at", 6) AS "at", round(log10(value), 6) AS power, major FROM Z""")
def bar_decades(spark, d):
    """Ticks of a logarithmic colour bar for the prices of each order, their values as powers of ten: by decades where they span enough."""
    return axes.colorbar_ticks(_bars(spark, d), "lo", "hi", scale.LOG).select("bar", _r("at").alias("at"), _r(F.log10("value")).alias("power"), "major")


@query(f"WITH {_BARS} SELECT bar, k / 20.0::DOUBLE AS at, round(lo + greatest(hi - lo, 1e-30) * (0.5 + 0.5 * sign(k / 10.0::DOUBLE - 1) * pow(k / 10.0::DOUBLE - 1, 2)), 6) AS value, k % 5 = 0 AS major FROM B, (SELECT unnest(range(0, 21)) AS k)")
def bar_ticks(spark, d):
    return axes.colorbar_ticks(_bars(spark, d), "lo", "hi", scale.SQRT).select("bar", "at", _r("value").alias("value"), "major")


# --- grids with metadata -----------------------------------------------------------------------------------------------

_X_NAMES, _Y_NAMES = ["cells", "lon", "a", "HEALPix_cell", "east"], ["b", "lat"]


@query(f"""WITH P AS (SELECT p_partkey AS pos, p_size::BIGINT AS s, p_partkey % 6 AS w, {_list(_X_NAMES)}[p_partkey % 5 + 1] AS x, {_list(_Y_NAMES)}[p_partkey // 5 % 2 + 1] AS y, 12 * p_size::BIGINT * p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS n FROM part),
N AS (SELECT *, CASE WHEN w IN (0, 2) AND s <= 29 THEN pow(2, s)::BIGINT WHEN n % 12 = 0 AND floor(sqrt(n / 12)) = sqrt(n / 12) THEN sqrt(n / 12)::BIGINT END AS side FROM P),
H AS (SELECT *, side IS NOT NULL AND (w < 4 OR x IN ('cells', 'HEALPix_cell')) AS hp FROM N)
SELECT pos, CASE WHEN hp THEN 'healpix' WHEN x IN ('cells', 'lon', 'HEALPix_cell') OR y = 'lat' THEN 'regional' ELSE 'global' END AS kind, CASE WHEN hp THEN side END AS nside,
  CASE WHEN hp THEN CASE WHEN w IN (1, 5) THEN 'ring' ELSE 'nested' END END AS ordering, CASE WHEN hp THEN CASE WHEN w IN (1, 5) THEN 4 ELSE 5 END WHEN x IN ('cells', 'lon', 'HEALPix_cell') OR y = 'lat' THEN 1 ELSE 0 END AS mode,
  CASE WHEN hp THEN 360.0 WHEN x IN ('cells', 'lon', 'HEALPix_cell') OR y = 'lat' THEN s * 8 ELSE 180 END::DOUBLE AS east FROM H""")
def grid_of_blocks(spark, d):
    """Grids by axes and by the metadata of their variables: six ways of writing these, names of axes that say cells, longitudes or nothing, and
    numbers of cells that are and are not those of a HEALPix grid."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    pick = lambda names, at: F.get(F.array(*map(F.lit, names)), (at % len(names)).cast("int"))
    pixels = 12 * s * s + F.when(k % 7 == 0, 1).otherwise(0)
    axis = lambda name, dim, size, *at: F.array(*[F.struct(F.lit(name).alias("axis"), dim.alias("dim"), size.alias("size"), F.lit(i).alias("idx"), v.cast("double").alias("value")) for i, v in enumerate(at)])
    ends = F.concat(axis("x", pick(_X_NAMES, k), pixels, F.lit(0), s * 8), axis("y", pick(_Y_NAMES, F.floor(k / 5)), F.lit(1).cast("long"), -s, s))
    rows = _attributed(spark, d)
    found = grids.detect(rows.select(k.alias("pos"), F.explode(ends).alias("e")).select("pos", "e.*"), "pos", blocks=rows.select(k.alias("pos"), F.col("a").alias("attributes")))
    return grids.properties(found, F.col("ordering") == "nested").select("pos", "kind", "nside", "ordering", "mode", "east")


# --- variables, palettes, parts of closed forms ------------------------------------------------------------------------


@query(
    sql("VAR", "").rstrip()
    + """, G AS (SELECT grp AS path, count(*) AS direct, min(pos) AS first FROM VAR GROUP BY 1),
U AS (SELECT path, direct, direct AS total, first FROM G UNION ALL SELECT split_part(path, '/', 1), 0, direct, first FROM G UNION ALL SELECT '', 0, direct, first FROM G),
S AS (SELECT path, sum(direct)::BIGINT AS direct, sum(total)::BIGINT AS total, min(first) AS first FROM U GROUP BY 1),
N AS (SELECT *, CASE WHEN path = '' THEN NULL WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '' END AS parent FROM S)
SELECT path, parent, string_split(path, '/')[-1] AS name, CASE WHEN path = '' THEN 0 ELSE len(string_split(path, '/')) END AS depth, direct, total, first, row_number() OVER (PARTITION BY parent ORDER BY first, path) - 1 AS place FROM N"""
)
def var_tree(spark, d):
    return catalog.variable_tree(views.variables(spark, d)).select("path", "parent", "name", "depth", "direct", "total", "first", F.col("place").cast("long").alias("place"))


@query("""WITH C AS (SELECT p_size AS code, count(*) % 256 AS r, min(p_partkey) % 256 AS g, max(p_partkey) % 256 AS b FROM part WHERE p_size <= 40 GROUP BY 1)
SELECT l_orderkey AS o, l_linenumber AS l, r, g, b FROM lineitem LEFT JOIN C ON code = l_quantity::INT""")
def palette_join(spark, d):
    """Line items as cells of codes (their quantities), and a palette of a colour for each size of parts up to 40."""
    k = F.col("p_partkey")
    palette = views.table(spark, d, "part").where("p_size <= 40").groupBy(F.col("p_size").cast("int").alias("code")).agg((F.count("*") % 256).alias("r"), (F.min(k) % 256).alias("g"), (F.max(k) % 256).alias("b"))
    cells = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_quantity").cast("int").alias("code"))
    return relate.palette_colours(cells, palette, ["code"], ["r", "g", "b"]).drop("code")


@query(f"""WITH E AS (SELECT event_id AS id, event_id % 20 AS t, event_id * 13 % 32 AS x, event_id * 7 % 32 AS y, value FROM events), F AS (SELECT *, 2 * pi() * (t / 19.0::DOUBLE) AS phi, t / 19.0::DOUBLE AS ft FROM E WHERE t >= 12 AND x >= 4 AND x < 20)
SELECT id, round(5 + (50 + 30 * sin(phi)) * exp(-(pow(x / 31.0::DOUBLE - 0.5 - 0.3 * cos(phi), 2) + pow(y / 31.0::DOUBLE - 0.5 - 0.3 * sin(phi), 2) + pow(9 / 31.0::DOUBLE - 0.2 - 0.6 * ft, 2)) / 0.045), 5) AS v FROM F""")
def packet_block(spark, d):
    """Events that lie in a part of the moving packet (late steps, one layer, some columns), with its value there."""
    sizes = {"t": 20, "z": 32, "y": 32, "x": 32}
    part = procedural.block(spark, sizes, t=Range(12, 99), z=Range(9, 10), x=Range(4, 20))
    part = part.withColumn("v", procedural.packet(*[F.col(c) for c in sizes], tuple(sizes.values())))
    e = F.col("event_id")
    at = views.table(spark, d, "events").select(e.alias("id"), (e % 20).alias("t"), (e * 13 % 32).alias("x"), (e * 7 % 32).alias("y"))
    return at.join(part, ["t", "y", "x"]).select("id", _r("v", 5).alias("v"))

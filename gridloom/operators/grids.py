"""Grids: DGGS metadata, what grid a pair of axes makes, cells by normalised place, and HEALPix corners."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import healpix
from gridloom.functions.scale import finite, slot_of

# Names of a dimension of HEALPix cells.
CELL_NAMES = ["cell", "cells", "pix", "pixels", "ncells"]
# Attributes that say a field of the DGGS metadata; the first present one counts.
DGGS_ATTRIBUTES = {
    "name": ["dggs_name", "dggs:name", "grid_name"],
    "spatial_dimension": ["dggs_spatial_dimension", "dggs:spatial_dimension", "spatial_dimension"],
    "refinement_level": ["dggs_refinement_level", "dggs:refinement_level", "healpix_zoom", "healpix_level"],
    "indexing_scheme": ["dggs_indexing_scheme", "dggs:indexing_scheme", "indexing_scheme", "healpix_order", "ordering"],
    "coordinate": ["dggs_coordinate", "dggs:coordinate", "coordinate"],
}

# A step may differ from the mean by this share; spans of longitude and latitude that cover the globe; the most
# western start of an axis that counts from 0 to 360; values at or over the limit count as missing in corner means.
UNEVEN, GLOBAL_LON, GLOBAL_LAT, FROM_ZERO, LIMIT = 0.0005, 350.0, 160.0, -5.0, 1e30


def is_cell_name(dim: Column) -> Column:
    low = F.lower(F.trim(dim))
    return low.isin(CELL_NAMES) | low.contains("healpix")


def is_x_name(dim: Column) -> Column:
    low = F.lower(F.trim(dim))
    return (low == "x") | low.contains("lon") | low.contains("col") | is_cell_name(dim)


def is_y_name(dim: Column) -> Column:
    low = F.lower(F.trim(dim))
    return (low == "y") | low.contains("lat") | low.contains("row")


# --- DGGS metadata -----------------------------------------------------------------------------------------------------


def _attribute(attributes: Column, *names: str) -> Column:
    return F.coalesce(*[F.try_element_at(attributes, F.lit(n)) for n in names])


def _whole(text: Column) -> Column:
    return F.when(F.regexp_like(text, F.lit(r"^\+?[0-9]{1,9}$")), text.cast("long"))


def dggs(attributes: Column) -> Column:
    """DGGS metadata (struct of name, refinement_level, spatial_dimension, indexing_scheme, coordinate and compression) of a map of attributes; null where there are none.

    All three ways of writing them are brought to one map of texts by field: a JSON object under ``dggs``, the bare word healpix there, and
    attributes of their own (``DGGS_ATTRIBUTES``).  The first that has a name is read."""
    text = _attribute(attributes, "dggs")
    fields = [*DGGS_ATTRIBUTES, "compression"]
    own = F.map_filter(
        F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[_attribute(attributes, *DGGS_ATTRIBUTES.get(f, [f])) for f in fields])),
        lambda _, v: v.isNotNull(),
    )
    lower_name = lambda said: F.transform_values(said, lambda k, v: F.when(k == "name", F.lower(v)).otherwise(v))
    # A default stands where the map lacks the field.
    ways = [
        (F.from_json(text, "map<string,string>"), ""),
        (F.when(F.lower(text) == "healpix", F.create_map(F.lit("name"), F.lower(text))), ""),
        (lower_name(own), "cells"),
    ]
    said = F.coalesce(*[F.when(F.try_element_at(m, F.lit("name")).isNotNull(), F.struct(m.alias("m"), F.lit(space).alias("space"))) for m, space in ways])
    field = lambda name: F.try_element_at(said["m"], F.lit(name))
    values = {f: field(f) for f in ("name", "refinement_level", "spatial_dimension", "indexing_scheme", "coordinate", "compression")}
    values |= {"refinement_level": _whole(values["refinement_level"]), "spatial_dimension": F.coalesce(values["spatial_dimension"], said["space"])}
    return F.when(said.isNotNull(), F.struct(*[v.alias(f) for f, v in values.items()]))


def is_healpix(meta: Column) -> Column:
    return F.coalesce(F.lower(meta["name"]).contains("healpix"), F.lit(False))


def matches_dim(meta: Column, dim: Column) -> Column:
    """Whether the metadata speaks of this dimension as its HEALPix cells."""
    space = F.coalesce(meta["spatial_dimension"], F.lit(""))
    return is_healpix(meta) & ((space == "") | (F.lower(space) == F.lower(dim)) | is_cell_name(dim))


def nside(meta: Column, size: Column) -> Column:
    """nside by refinement level, else by the number of pixels; null where neither gives one."""
    level = F.when(meta["refinement_level"].between(0, 29), meta["refinement_level"])
    return F.coalesce(F.pow(F.lit(2.0), level).cast("long"), healpix.nside_of(size))


# What says that pixels are in nested order, in the scheme of HEALPix metadata and in attributes.
NESTED_SIGNS = [("indexing_scheme", r"^(nested|nest)$|uniq"), ("healpix_nest", r"^(true|1)$"), ("healpix_order", r"^nested$"), ("ordering", r"^nested$"), ("grid_type", r"nested")]


def ordering(attributes: Column, meta: Column) -> Column:
    """nested or ring: by the first of ``NESTED_SIGNS`` where there are HEALPix metadata, by any of the others where there are none."""
    texts = [meta["indexing_scheme"], *[_attribute(attributes, name) for name, _ in NESTED_SIGNS[1:]]]
    signs = F.array(*[F.coalesce(F.regexp_like(F.lower(t), F.lit(pattern)), F.lit(False)) for t, (_, pattern) in zip(texts, NESTED_SIGNS, strict=True)])
    asked = F.when(is_healpix(meta), F.slice(signs, 1, 1)).otherwise(F.slice(signs, 2, len(NESTED_SIGNS) - 1))
    return F.when(F.array_contains(asked, True), "nested").otherwise("ring")


# --- Grids of pairs of axes --------------------------------------------------------------------------------------------


# Attributes that alone say HEALPix where they are present, and those that say it by their text.
HEALPIX_ATTRIBUTES, HEALPIX_TEXTS = ["healpix_zoom", "healpix_nest", "healpix_order"], {"grid_type": "healpix", "ordering": "nested"}


def says_healpix(attributes: Column, meta: Column) -> Column:
    """Whether the attributes of a variable speak of HEALPix, in DGGS metadata or in others."""
    texts = [F.lower(_attribute(attributes, name)).contains(word) for name, word in HEALPIX_TEXTS.items()]
    said = is_healpix(meta)
    for sign in [*[F.map_contains_key(attributes, name) for name in HEALPIX_ATTRIBUTES], *texts]:
        said = said | F.coalesce(sign, F.lit(False))
    return said


def detect(axes: DataFrame, *keys: str, blocks: DataFrame | None = None) -> DataFrame:
    """The grid of each pair of axes: kind (global, regional, irregular, healpix), nside, width, height, west, east, south, north, and
    for irregular ones the coordinates xs and ys.

    ``blocks``: keys and attributes (a map of texts) of the variables that the axes belong to, one row each.  With them the metadata count too: they
    may say HEALPix and nside where names of dimensions do not, and the result has ``ordering`` (nested or ring; null where not HEALPix).

    ``axes``: keys, axis ('x' or 'y'), dim (its name), size, idx and value; an axis without coordinates is one row whose value is
    null.  One axis of one grid is sorted in one task; it is as long as the dimension."""
    order = Window.partitionBy(*keys, "axis").orderBy("idx")
    step = F.abs(F.col("value") - F.lag("value").over(order))
    steps = axes.withColumn("_s", F.when(step > 1e-7, step))
    one = steps.groupBy(*keys, "axis").agg(
        F.first("dim").alias("dim"),
        F.max("size").alias("size"),
        F.min_by("value", "idx").alias("first"),
        F.max_by("value", "idx").alias("last"),
        F.coalesce((F.max("_s") - F.min("_s")) / F.avg("_s") > UNEVEN, F.lit(False)).alias("uneven"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("idx", "value")))), lambda s: s["value"]).alias("values"),
    )
    side = lambda a: F.max(F.when(F.col("axis") == a, F.struct("dim", "size", "first", "last", "uneven", "values"))).alias(a)
    both = one.groupBy(*keys).agg(side("x"), side("y"))
    x, y = F.col("x"), F.col("y")
    bounds = {"west": F.least(x["first"], x["last"]), "east": F.greatest(x["first"], x["last"]), "south": F.least(y["first"], y["last"]), "north": F.greatest(y["first"], y["last"])}
    cells, pixels = is_cell_name(x["dim"]) | is_cell_name(y["dim"]), x["size"] * y["size"]
    own = {"_nside": F.when(cells, healpix.nside_of(pixels))}
    extra = []
    if blocks is not None:
        told = blocks.select(*keys, F.col("attributes").alias("_a"), dggs(F.col("attributes")).alias("_meta"))
        both = both.join(told, list(keys), "left")
        a, meta = F.col("_a"), F.col("_meta")
        own = {"_nside": F.when(cells | says_healpix(a, meta), nside(meta, pixels)), "_ordering": ordering(a, meta)}
        extra = [F.when(F.col("kind") == "healpix", F.col("_ordering")).alias("ordering")]
    found = both.withColumns({**own, **{f"_{k}": v for k, v in bounds.items()}})
    spatial_x, spatial_y = is_x_name(x["dim"]), is_y_name(y["dim"])
    whole = spatial_x & spatial_y & (F.col("_east") - F.col("_west") >= GLOBAL_LON) & (F.col("_north") - F.col("_south") >= GLOBAL_LAT)
    kind = (
        F.when(F.col("_nside").isNotNull(), "healpix")
        .when(x["first"].isNull() | y["first"].isNull(), "global")
        .when(x["uneven"] | y["uneven"], "irregular")
        .when(whole & (F.col("_west") < FROM_ZERO), "global")
        .when(spatial_x | spatial_y, "regional")
        .otherwise("global")
    )
    globe = {"west": F.when(F.col("kind") == "healpix", 0.0).otherwise(-180.0), "east": F.when(F.col("kind") == "healpix", 360.0).otherwise(180.0), "south": F.lit(-90.0), "north": F.lit(90.0)}
    placed = F.col("kind").isin("regional", "irregular")
    return found.withColumn("kind", kind).select(
        *keys, "kind", F.col("_nside").alias("nside"), x["size"].alias("width"), y["size"].alias("height"),
        *[F.when(placed, F.col(f"_{k}")).otherwise(v).alias(k) for k, v in globe.items()],
        F.when(F.col("kind") == "irregular", x["values"]).alias("xs"), F.when(F.col("kind") == "irregular", y["values"]).alias("ys"), *extra,
    )


def properties(grids: DataFrame, nested: Column) -> DataFrame:
    """Adds mode (0 to 5), is_global and aspect to grids of :func:`detect`; ``nested`` tells the two orders of HEALPix apart."""
    kind = F.col("kind")
    mode = F.when(kind == "global", 0).when(kind == "regional", 1).when(kind == "irregular", 2).when(nested, 5).otherwise(4)
    sphere = kind.isin("global", "healpix")
    wide = (F.col("east") - F.col("west") >= GLOBAL_LON) & (F.col("north") - F.col("south") >= GLOBAL_LAT)
    ratio = F.greatest(F.lit(0.1), F.least(F.lit(10.0), F.greatest("width", F.lit(1)) / F.greatest("height", F.lit(1))))
    return grids.withColumns({"mode": mode, "is_global": sphere | wide, "aspect": F.when(sphere, 2.0).otherwise(ratio)})


def same_geometry(a: Column, b: Column) -> Column:
    """Whether two grids (structs with mode, nside, bounds, xs, ys) have the same cells in the same places; modes tell orders apart."""
    alike = F.lit(True)
    for field in ("mode", "nside", "west", "east", "south", "north", "xs", "ys"):
        alike = alike & a[field].eqNullSafe(b[field])
    return alike


# --- Cells by place ----------------------------------------------------------------------------------------------------


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(c, F.lit(1.0)))


def norm_cell(u: Column, v: Column, width: int, height: int) -> Column:
    """struct<x, y> of the cell at a normalised place of a regular grid; places outside count as the edge."""
    at = lambda c, n: F.least(F.floor(_unit(c) * max(n, 1)), F.lit(max(n, 1) - 1)).cast("long")
    return F.struct(at(u, width).alias("x"), at(v, height).alias("y"))


def norm_pixel(nside: int, u: Column, v: Column, surface: bool = False) -> Column:
    """Ring-order pixel at a normalised place: of a map (longitude 0 in the middle), or of a surface (longitude 0 at its left)."""
    turn = _unit(u) if surface else _unit(u) - 0.5
    return healpix.ang2pix(nside, turn * (2 * math.pi), (0.5 - _unit(v)) * math.pi)


def norm_centre(x: Column, y: Column, width: int, height: int) -> Column:
    """struct<u, v> of the middle of a cell of a regular grid, as shares of its width and height."""
    return F.struct(((x + 0.5) / max(width, 1)).alias("u"), ((y + 0.5) / max(height, 1)).alias("v"))


def pixel_centre(nside: int, pix: Column, nested: bool = False, surface: bool = False) -> Column:
    """struct<u, v> of a pixel's centre, where :func:`norm_pixel` finds it again; the meridian opposite to longitude 0 is a map's right edge."""

    def place(s: Column) -> Column:
        turn = s["at"]["lon"] / (2 * math.pi)
        u = turn if surface else F.when(turn > 0.5, turn - 0.5).otherwise(turn + 0.5)
        return F.struct(_unit(u).alias("u"), _unit(0.5 - s["at"]["lat"] / math.pi).alias("v"))

    return healpix.let(place, at=(healpix.pix2ang_nested if nested else healpix.pix2ang)(nside, pix))


def surface_place(place: Column, aspect: float) -> Column:
    """struct<x, z> of a place struct<u, v> on a surface that is 2 long and ``aspect`` times as wide, around its middle."""
    return F.struct(((2 * place["u"] - 1) * aspect).alias("x"), (2 * place["v"] - 1).alias("z"))


def axis_places(axis: DataFrame, *keys: str) -> DataFrame:
    """Axes (keys, idx, value), with ``share``: how far each value is from the first to the last one, 0 to 1; an axis
    that ends where it starts counts as one long.  An axis of one value has the middle; null keys are keys."""
    ends = axis.groupBy(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)]).agg(F.min_by("value", "idx").alias("_a"), F.max_by("value", "idx").alias("_b"), F.count("*").alias("_n"))
    span = F.when(F.abs(F.col("_b") - F.col("_a")) > 1e-6, F.col("_b") - F.col("_a")).otherwise(1.0)
    share = F.when(F.col("_n") > 1, _unit((F.col("value") - F.col("_a")) / span)).otherwise(0.5)
    same = [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)]
    return axis.join(ends, same).withColumn("share", share).drop("_a", "_b", "_n", *[f"_k{n}" for n in range(len(keys))])


def value_at(points: DataFrame, cells: DataFrame, u: Column, v: Column, width: int, height: int) -> DataFrame:
    """Points with the cell (x, y) under them and its value; points over cells that are not there have a null."""
    placed = points.withColumn("_c", norm_cell(u, v, width, height)).withColumns({"x": F.col("_c.x"), "y": F.col("_c.y")}).drop("_c")
    return placed.join(cells.select("x", "y", "v"), ["x", "y"], "left")


def pixel_outline(nside: int, pix: Column) -> Column:
    """array<struct<lon, lat>> of a ring-order pixel: its exact north, east, south and west corners (radians).

    In HEALPix's own plane rings are evenly spaced and a pixel is a square on its corner, one ring high to either side.  A ring has 4 m pixels,
    where m grows by one a ring from a pole until it is nside; from ring to ring, longitudes measured from the middle of the quarter turn stretch
    as m does.  At a pole, where m is 0, that middle is taken."""
    around = lambda lon: F.pmod(lon, F.lit(2 * math.pi))
    quarter = math.pi / 2

    def width(ring: Column) -> Column:
        return F.least(ring, F.lit(nside), 4 * nside - ring)

    def lat(ring: Column) -> Column:
        belt = 2.0 * (2 * nside - ring) / (3.0 * nside)
        cap = F.signum((2 * nside - ring).cast("double")) * (1 - width(ring) * width(ring) / (3.0 * nside * nside))
        return F.asin(F.when(ring.between(nside, 3 * nside), belt).otherwise(cap))

    def outline(s: Column) -> Column:
        ring, lon = s["at"]["ring"], s["c"]["lon"]
        middle = (F.floor(lon / quarter) + 0.5) * quarter
        # The ring over or under the pixel's; the pole itself for the first and the last.
        beside = lambda r: F.struct(around(middle + F.when(width(r) > 0, (lon - middle) * width(ring) / width(r)).otherwise(0.0)).alias("lon"), lat(r).alias("lat"))
        abreast = lambda way: F.struct(around(lon + way * (math.pi / 4) / width(ring)).alias("lon"), lat(ring).alias("lat"))
        return F.array(beside(ring - 1), abreast(1), beside(ring + 1), abreast(-1))

    return healpix.let(outline, at=healpix.pix2ring(nside, pix), c=healpix.pix2ang(nside, pix))


def corner_means(cells: DataFrame, nside: int) -> DataFrame:
    """pix, corner_x, corner_y (0 or 1) and v: the mean of the finite pixels of the same face that meet at the corner, the pixel's own
    value where there are none.  ``cells``: pix in nested order, one row a pixel, and v."""
    area, bits = nside * nside, max(1, nside.bit_length() - 1)
    at = cells.withColumn("_at", healpix.deinterleave(F.col("pix") % area, bits))
    both = F.array(*[F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy")) for dx in (0, 1) for dy in (0, 1)])
    met = at.select("pix", "v", F.floor(F.col("pix") / area).alias("_face"), "_at", F.explode(both).alias("_d"))
    met = met.select("pix", "v", "_face", (F.col("_at.x") + F.col("_d.dx")).alias("_x"), (F.col("_at.y") + F.col("_d.dy")).alias("_y"), F.col("_d.dx").alias("corner_x"), F.col("_d.dy").alias("corner_y"))
    value = finite(F.col("v"))
    means = met.groupBy("_face", "_x", "_y").agg(F.avg(F.when(F.abs(value) < LIMIT, value)).alias("_mean"))
    return met.join(means, ["_face", "_x", "_y"]).select("pix", "corner_x", "corner_y", F.coalesce("_mean", "v").alias("v"))


# --- Variables ---------------------------------------------------------------------------------------------------------


def band_facts(shape: Column, attributes: Column, long_name: Column) -> Column:
    """struct<rgb, bands, cmyk>: at least three bands, their number (3 where there is no band axis), and four inks."""
    bands = F.when(F.size(shape) >= 3, F.get(shape, F.lit(0)).cast("long"))
    ink = lambda name: F.coalesce(F.lower(_attribute(attributes, name)) == "cmyk", F.lit(False))
    cmyk = ink("photometric") | ink("color_space") | F.coalesce(long_name.contains("CMYK"), F.lit(False))
    return F.struct(F.coalesce(bands >= 3, F.lit(False)).alias("rgb"), F.coalesce(bands, F.lit(3).cast("long")).alias("bands"), cmyk.alias("cmyk"))


def chosen_bounds(recompute: Column, own: Column, block: Column) -> Column:
    """struct<lo, hi>: bounds of the values where they are computed again, else those of the block, and (0, 1) where these are not finite."""
    good = finite(block["lo"]).isNotNull() & finite(block["hi"]).isNotNull()
    pair = lambda lo, hi: F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))
    return F.when(recompute, pair(own["lo"], own["hi"])).when(good, pair(block["lo"], block["hi"])).otherwise(pair(F.lit(0.0), F.lit(1.0)))


# Names looked for where the store itself names no coordinate.
COORDINATE_NAMES = ["lat", "latitude", "y", "lon", "longitude", "x", "time", "depth", "lev", "level", "height"]


def coordinate_candidates(variables: DataFrame, bins: int = 32) -> DataFrame:
    """candidate and rank (from 1): 1-D variables, then dimensions and DGGS coordinates of the variables in order, then usual names.

    ``variables``: pos, name, shape, dims, attributes.  Ranks come from counts of ``bins`` spans of the variables with about as many of them each, and
    from the order inside a span; only the counts, at most three for a span, are summed in one task."""
    clean = lambda c: F.regexp_replace(F.trim(c), "^/+", "")
    place = lambda step, name, at: F.struct(F.lit(step).alias("step"), F.col("pos").cast("long").alias("pos"), at.cast("long").alias("at"), clean(name).alias("name"))
    single = F.when((F.size("shape") == 1) & (F.get("shape", F.lit(0)) > 0), F.array(place(1, F.col("name"), F.lit(0))))
    dims = F.transform("dims", lambda d, k: place(2, d, k))
    meta = F.array(place(2, dggs(F.col("attributes"))["coordinate"], F.size("dims")))
    usual = F.array(*[F.struct(F.lit(3).alias("step"), F.lit(0).cast("long").alias("pos"), F.lit(k).cast("long").alias("at"), F.lit(n).alias("name")) for k, n in enumerate(COORDINATE_NAMES)])
    empty = F.slice(usual, 1, 0)
    named = variables.select(F.explode(F.concat(F.coalesce(single, empty), F.coalesce(dims, empty), meta)).alias("c"))
    named = named.unionAll(variables.sparkSession.range(1).select(F.explode(usual).alias("c"))).where("c.name <> ''")
    first = named.groupBy(F.col("c.name").alias("candidate")).agg(F.min(F.struct("c.step", "c.pos", "c.at")).alias("_at")).select("candidate", "_at.*")
    edges = variables.agg(F.percentile_approx(F.col("pos").cast("long"), [k / bins for k in range(1, bins)], 10 * bins)).first()[0] or []
    spans = first.withColumn("_span", F.coalesce(slot_of("pos", sorted(set(edges))), F.lit(-1)))
    counts = spans.groupBy("step", "_span").agg(F.count("*").alias("_n"))
    before = Window.orderBy("step", "_span").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("step", "_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("step", "_span").orderBy("pos", "at", "candidate"))
    return spans.join(starts, ["step", "_span"]).select("candidate", (F.col("_start") + inside).cast("int").alias("rank"))

"""Registered queries that keep an array of the tables in a store and scan it from there, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridloom import shared_dir
from gridloom.operators import pyramid
from gridloom.operators.select import Range
from gridloom.plans import views
from gridloom.plans.registry import _r, query
from gridloom.plans.views import sql
from gridloom.sources import datasource, geotiff, netcdf3, zarr

WIDTH, LINES = 64, 64  # columns of the matrix, and lines of a chunk


def _stored(rows, array, **how):
    """A store in the shared folder with one array, a line for each row of the embeddings."""
    spark = rows.sparkSession
    store = f"{shared_dir(spark)}/arrays-{uuid.uuid4().hex}.zarr"
    height = (rows.agg(F.max("vec_id")).first()[0] or 0) + 1
    chunks = zarr.chunk_rows(rows.select("vec_id", array.alias("a")), "vec_id", "a", WIDTH, LINES)
    zarr.write(chunks, store, "data/matrix", ["y", "x"], [height, WIDTH], [LINES, WIDTH], **how)
    return store


@query(sql("E", "SELECT y, x, v FROM E WHERE y >= 100 AND y < 300 AND x >= 8 AND x < 24"))
def zarr_hyperslab(spark, d):
    """Version 3, zstd and a checksum: a hyperslab opens the files of its chunks only."""
    store = _stored(views.table(spark, d, "embeddings"), F.col("embedding"), codecs=["zstd", "crc32c"])
    box = {"y": Range(100, 300), "x": Range(8, 24)}
    return zarr.cells(zarr.chunks(spark, store, "data/matrix", verify=True, **box), ["y", "x"], **box)


@query(sql("E", "SELECT y, x, CASE WHEN (y + x) % 7 <> 0 THEN round(10 + floor(v * 10000) / 10000, 4) END AS v FROM E"))
def zarr_packed(spark, d):
    """Version 2, big-endian 16-bit integers, shuffle and zlib: scale, offset and fill value undone on the way in."""
    packed = F.transform("embedding", lambda v, k: F.when((F.col("vec_id") + k) % 7 != 0, F.floor(v.cast("double") * 10000).cast("double")).otherwise(-32768.0))
    store = _stored(views.table(spark, d, "embeddings"), packed, codecs=["shuffle", "zlib"], version=2, data_type=">i2", attributes={"scale_factor": 0.0001, "add_offset": 10, "_FillValue": -32768})
    return zarr.cells(zarr.chunks(spark, store, "data/matrix"), ["y", "x"]).withColumn("v", _r("v", 4))


@query(sql("E", "SELECT y, x, v FROM E WHERE y < 500 AND x >= 40"))
def zarr_blosc(spark, d):
    """Version 2 as most stores have it: Blosc with shuffled bytes."""
    store = _stored(views.table(spark, d, "embeddings"), F.col("embedding"), codecs=["blosc"], version=2)
    box = {"y": Range(0, 500), "x": Range(40, WIDTH)}
    return zarr.cells(zarr.chunks(spark, store, "data/matrix", **box), ["y", "x"], **box)


@query(sql("E", "SELECT y, x, v FROM E WHERE y >= 30 AND y < 400 AND x >= 20 AND x < 36"))
def zarr_sharded(spark, d):
    """Files of 64 lines that hold chunks of 8 by 16: the range of cells plans the chunks, which are read by range from few files."""
    bits = {"name": "blosc", "configuration": {"cname": "zstd", "shuffle": "bitshuffle"}}
    store = _stored(views.table(spark, d, "embeddings"), F.col("embedding"), codecs=[bits, "crc32c"], inner=[8, 16])
    datasource.register(spark)
    cells = spark.read.format(datasource.FORMAT).option("variable", "data/matrix").option("verify", "true").load(store)
    return cells.where("y >= 30 AND y < 400 AND x >= 20 AND x < 36")


@query(sql("V", "SELECT d AS t, h AS y, k AS x, v::FLOAT::DOUBLE AS v FROM V WHERE d >= 3 AND d < 9"))
def zarr_steps(spark, d):
    """Version 3, gzip: a chunk a day; a range of days reads its own files."""
    store = f"{shared_dir(spark)}/arrays-{uuid.uuid4().hex}.zarr"
    size = views.volume_shape(spark, d)
    days = views.volume(spark, d).groupBy(F.col("d").alias("c_t")).agg(F.array_sort(F.collect_list(F.struct("h", "k", F.coalesce("v", F.lit(float("nan"))).alias("v")))).alias("_s"))
    zero = F.lit(0).cast("long")
    chunks = days.select("c_t", zero.alias("c_y"), zero.alias("c_x"), F.array(*[F.lit(n).cast("long") for n in (1, size["h"], size["k"])]).alias("shape"), F.transform("_s", lambda s: s["v"]).alias("values"))
    zarr.write(chunks, store, "events", ["t", "y", "x"], [size["d"], size["h"], size["k"]], [1, size["h"], size["k"]], codecs=["gzip"])
    return zarr.cells(zarr.chunks(spark, store, "events", t=Range(3, 9)), ["t", "y", "x"], t=Range(3, 9))


@query(sql("E", "SELECT y, x, v FROM E WHERE y >= 70 AND y <= 199 AND x > 11 AND x IN (13, 14, 30)"))
def zarr_source(spark, d):
    """The format of the data source: comparisons on index columns plan the partitions, and no folder is listed."""
    store = _stored(views.table(spark, d, "embeddings"), F.col("embedding"), codecs=["zstd"])
    datasource.register(spark)
    cells = spark.read.format(datasource.FORMAT).option("variable", "data/matrix").load(store)
    return cells.where("y >= 70 AND y <= 199 AND x > 11 AND x IN (13, 14, 30)")


@query(
    sql("VAR", "").rstrip()
    + """, A AS (SELECT grp AS name, count(*) AS n, max(units) AS own, min(price) AS low FROM VAR GROUP BY grp), H AS (SELECT string_split(name, '/')[1] AS top, max(n) AS most FROM A GROUP BY 1)
SELECT name, n AS length, coalesce(own, 'from ' || string_split(name, '/')[1]) AS units, 'up to ' || most AS long_name FROM A JOIN H ON H.top = string_split(name, '/')[1]"""
)
def zarr_consolidated(spark, d):
    """A store that is known from one document: an array for every type and brand of parts, units of its own or of the group above, a long
    name of the group.  The document is as long as there are types and brands, not parts."""
    store = f"{shared_dir(spark)}/arrays-{uuid.uuid4().hex}.zarr"
    kinds = views.variables(spark, d).select(F.regexp_extract("name", "^(.*)/[^/]*$", 1).alias("name"), "units").groupBy("name").agg(F.count("*").alias("n"), F.max("units").alias("units")).collect()
    tops: dict = {}
    documents = {}
    for r in kinds:
        top = r.name.split("/")[0]
        tops[top] = max(tops.get(top, 0), r.n)
        documents[f"{r.name}/.zarray"] = {"zarr_format": 2, "shape": [r.n], "chunks": [min(r.n, 1000)], "dtype": "<f4", "fill_value": "NaN", "order": "C", "filters": None, "compressor": None}
        documents[f"{r.name}/.zattrs"] = {"_ARRAY_DIMENSIONS": ["part"], **({"units": r.units} if r.units else {})}
    for top, most in tops.items():
        documents[f"{top}/.zgroup"] = {"zarr_format": 2}
        documents[f"{top}/.zattrs"] = {"units": f"from {top}", "long_name": f"up to {most}"}
    zarr.consolidate(spark, store, documents, version=2)
    return zarr.variables(spark, store).select("name", F.element_at("shape", 1).alias("length"), "units", "long_name")


@query(sql("E", "SELECT y, x, v FROM E WHERE y >= 100 AND y < 300 AND x >= 8 AND x < 24"))
def tiff_window(spark, d):
    """The matrix as TIFF files of 256 lines in tiles of 16 by 16: headers tell where tiles are, the window keeps some, and their byte ranges are
    read by all tasks."""
    folder = f"{shared_dir(spark)}/tiff-{uuid.uuid4().hex}"
    lines = zarr.chunk_rows(views.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("a")), "vec_id", "a", WIDTH, 256)
    geotiff.write(lines.select((F.col("c_y") * 256).alias("y0"), F.lit(0).cast("long").alias("x0"), "shape", "values"), folder, tile=16)
    top = (F.col("y") - F.col("north")).cast("long")
    found = geotiff.extents(spark, folder).where((top < 300) & (top + F.col("height") > 100) & (F.col("x") < 24) & (F.col("x") + F.col("width") > 8))
    tiles = geotiff.read_tiles(found).withColumn("origin", F.array((F.element_at("origin", 1) - F.col("north")).cast("long"), F.element_at("origin", 2)))
    return zarr.cells(tiles, ["y", "x"], y=Range(100, 300), x=Range(8, 24))


@query(sql("V", "SELECT d AS t, h AS y, k AS x, v::FLOAT::DOUBLE AS v FROM V WHERE d >= 5 AND d < 20 AND h >= 6 AND h < 18 AND k >= 1 AND k < 4"))
def netcdf_hyperslab(spark, d):
    """The volume as NetCDF files of a week each: a box of it by byte ranges; days by the files' own coordinate."""
    folder, size = f"{shared_dir(spark)}/netcdf-{uuid.uuid4().hex}", views.volume_shape(spark, d)
    week = F.floor(F.col("d") / 7).cast("long") * 7
    weeks = views.volume(spark, d).groupBy(week.alias("first")).agg(F.array_sort(F.collect_list(F.struct("d", "h", "k", F.coalesce("v", F.lit(float("nan"))).alias("v")))).alias("_s"))
    days = F.size("_s").cast("long") / (size["h"] * size["k"])
    blocks = weeks.select("first", F.array(days.cast("long"), *[F.lit(size[c]).cast("long") for c in "hk"]).alias("shape"), F.transform("_s", lambda s: s["v"]).alias("values"))
    netcdf3.write(blocks, folder, "v", ["t", "y", "x"])
    found = netcdf3.extents(spark, folder, "v", y=Range(6, 18), x=Range(1, 4)).where("lead >= 5 AND lead < 20")
    chunks = netcdf3.read_chunks(found).withColumn("origin", F.array(F.col("lead").cast("long"), F.element_at("origin", 2), F.element_at("origin", 3)))
    return zarr.cells(chunks, ["t", "y", "x"])


def _levels_sql(last: int) -> str:
    steps = ["P0 AS (SELECT h AS how, y, x, v FROM E, (SELECT unnest(['mean', 'max', 'min', 'nearest']) AS h))"]
    for k in range(last):
        box = "how, y // 2 AS y, x // 2 AS x"
        steps.append(f"P{k + 1} AS (SELECT {box}, CASE how WHEN 'mean' THEN avg(v) WHEN 'max' THEN max(v) ELSE min(v) END AS v FROM P{k} WHERE how <> 'nearest' GROUP BY how, y // 2, x // 2 UNION ALL SELECT {box}, v FROM P{k} WHERE how = 'nearest' AND y % 2 = 0 AND x % 2 = 0)")
    return ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT how, {k} AS level, y, x, round(v, 6) AS v FROM P{k}" for k in range(2, last + 1))


@query(sql("E", "").rstrip() + ", " + _levels_sql(8))
def pyramid_stored(spark, d):
    """All levels of the matrix from its chunks of 16 by 16, read once: four of a chunk itself, the rest from one cell a chunk."""
    rows = views.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    lines = zarr.chunk_rows(rows, "vec_id", "a", WIDTH, 16)
    # A line of chunks to its chunks.
    square = lines.select(F.col("c_y"), F.element_at("shape", 1).alias("n"), "values", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(WIDTH // 16 - 1).cast("long"))).alias("c_x"))
    own = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda k: F.slice("values", (k * WIDTH + F.col("c_x") * 16 + 1).cast("int"), 16)))
    chunks = square.select("c_y", "c_x", F.array(F.col("n"), F.lit(16).cast("long")).alias("shape"), own.alias("values"))
    found = pyramid.store(chunks, f"{shared_dir(spark)}/pyramid-{uuid.uuid4().hex}", 16, 9).where("level >= 2")
    flat = found.select("how", "level", "origin", "shape", F.posexplode("values").alias("p", "v"))
    y, x = (F.element_at("origin", k + 1) + at for k, at in enumerate((F.floor(F.col("p") / F.element_at("shape", 2)), F.col("p") % F.element_at("shape", 2))))
    return flat.select("how", "level", y.cast("long").alias("y"), x.cast("long").alias("x"), _r(F.when(~F.isnan("v"), F.col("v"))).alias("v"))

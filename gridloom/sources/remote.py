"""Addresses of object stores as columns: their parts, and their form for a plain web reader."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where a store is if its address does not say so, and a host with buckets in its paths.
REGION, COOPERATIVE = "us-east-1", "data.source.coop"


def _bare(url: Column) -> Column:
    return F.regexp_replace(F.trim(url), r"^(icechunk\+)+", "")


def parse(url: Column) -> Column:
    """struct<bucket, prefix, region, endpoint, path_style> of an s3, vcc or web address; null where it names no bucket."""
    bare = _bare(url)
    scheme = F.regexp_extract(bare, "^(s3|vcc)://", 1)
    parts = F.filter(F.split(F.regexp_replace(bare, "^((s3|vcc)://|(https?://)+)", ""), "/"), lambda p: p != "")
    host, rest = F.get(parts, F.lit(0)), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    joined = lambda a: F.when(F.size(a) > 0, F.array_join(a, "/"))
    after = lambda a: F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))
    amazon = r"^(.*?)\.s3[.-](.*)\.amazonaws\.com$"
    none = F.lit(None).cast("string")
    entry = lambda bucket, prefix, region, endpoint, style: F.struct(bucket.alias("bucket"), prefix.alias("prefix"), region.alias("region"), endpoint.alias("endpoint"), F.lit(style).alias("path_style"))
    region = F.lit(REGION)
    own = F.concat(F.when(bare.startswith("http://"), "http").otherwise("https"), F.lit("://"), host)
    return (
        F.when(url.isNull() | (F.size(parts) == 0), F.lit(None))
        .when(scheme != "", entry(host, joined(rest), region, none, False))
        .when(F.regexp_like(host, F.lit(amazon)), entry(F.regexp_extract(host, amazon, 1), joined(rest), F.regexp_extract(host, amazon, 2), none, False))
        .when((host == COOPERATIVE) & (F.size(rest) == 0), F.lit(None))
        .otherwise(entry(F.coalesce(F.get(rest, F.lit(0)), host), joined(after(rest)), region, own, True))
    )


def to_https(url: Column) -> Column:
    """The web address of an s3 or vcc address; others as they are."""
    bare = _bare(url)
    pattern = "^(?:s3|vcc)://([^/]*)(/?.*)$"
    web = F.concat(F.lit("https://"), F.regexp_extract(bare, pattern, 1), F.lit(".s3.amazonaws.com"), F.regexp_extract(bare, pattern, 2))
    return F.when(F.regexp_like(bare, F.lit(pattern)), web).otherwise(bare)


# Kinds that a target's ending may give where a plain Zarr store was named.
MORE_EXACT = {"remote_zarr": ["remote_icechunk", "remote_geotiff", "local_geotiff", "local_netcdf"], "local_zarr": ["local_icechunk", "local_netcdf", "local_geotiff", "remote_geotiff"]}


def resolve_kind(explicit: Column, inferred: Column, current: Column) -> Column:
    """The kind of a store: the one named, unless the one inferred is more exact; else the inferred, else the current."""
    better = F.lit(False)
    for kind, others in MORE_EXACT.items():
        better = better | F.coalesce((explicit == kind) & inferred.isin(others), F.lit(False))
    return F.when(better, inferred).otherwise(F.coalesce(explicit, inferred, current))

"""Lookups between tables: names in scopes, chunks in manifests, nearest series, requests in groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clip(cells: DataFrame, planes: list[tuple[dict[str, float], float]]) -> DataFrame:
    """Cells on the inner side of every plane: the weighted sum of their places is at least the plane's offset."""
    for weights, least in planes:
        cells = cells.where(reduce(lambda a, b: a + b, [F.lit(w) * F.col(c) for c, w in weights.items()]) >= least)
    return cells


def resolve_names(rows: DataFrame, definitions: DataFrame, scope: str, name: str, out: str) -> DataFrame:
    """``definitions`` (key, value; keys are unique): the value of ``scope/name``, else that of ``name``, else the name itself."""
    named = lambda k: definitions.select(F.col("key").alias(f"_k{k}"), F.col("value").alias(f"_v{k}"))
    scoped = rows.join(named(1), F.concat_ws("/", scope, name) == F.col("_k1"), "left").join(named(2), F.col(name) == F.col("_k2"), "left")
    return scoped.withColumn(out, F.coalesce("_v1", "_v2", name)).drop("_k1", "_v1", "_k2", "_v2")


def manifest_entries(chunks: DataFrame, manifest: DataFrame, on: list[str], precedence: list[Column], value: Column) -> DataFrame:
    """Each chunk with the entry of highest precedence that a manifest holds for it; chunks without one keep a null."""
    best = manifest.groupBy(*on).agg(F.max_by(value, F.struct(*[p.alias(f"p{k}") for k, p in enumerate(precedence)])).alias("entry"))
    return chunks.join(best, on, "left")


def palette_colours(cells: DataFrame, palette: DataFrame, on: list[str], channels: list[str]) -> DataFrame:
    """Cells with the colours that a palette (one row for each code) has for theirs; null where it has none.

    Spark broadcasts the palette where its size is known to be small, and shuffles both sides where it is not."""
    return cells.join(palette.select(*on, *channels), on, "left")


def nearest_series(samples: DataFrame, place: list[str], series: str, value: str, at: Column) -> DataFrame:
    """Per place the series whose finite value is closest to ``at``; ties go to the first series, and places without a finite value
    to the first of all."""
    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    distance = F.when(finite, F.abs(F.col(value) - at))
    return samples.groupBy(*place).agg(F.min_by(series, F.struct(F.coalesce(distance, F.lit(float("inf"))), F.col(series))).alias(series))


def fetch_groups(requests: DataFrame, source: list[str], step: str, chunk: int) -> DataFrame:
    """Requests by source and chunk-aligned window: one bulk fetch a row, its steps in order."""
    window = (F.floor(F.col(step) / chunk) * chunk).cast("long").alias("start")
    return requests.groupBy(*source, window).agg(F.sort_array(F.collect_set(step)).alias("steps"), F.count("*").alias("requests"))


def outcome_counts(results: DataFrame, by: list[str], ok: Column) -> DataFrame:
    return results.groupBy(*by).agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"))


def first_resident_step(blocks: DataFrame, by: list[str], start: str = "start") -> DataFrame:
    return blocks.groupBy(*by).agg(F.min(start).alias("first_step"))


def ordered_distinct(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Each key once, where it first stands."""
    return rows.groupBy(key).agg(F.min(order).alias("first"))


def compatible(a: Column, b: Column) -> Column:
    """Whether two shapes have equal rank and lengths."""
    return F.coalesce((F.size(a) == F.size(b)) & (a == b), F.lit(False))


def variable_label(name: Column, units: Column) -> Column:
    return F.coalesce(F.when(units.isNotNull(), F.concat(name, F.lit(" ("), units, F.lit(")"))), name, F.lit("Scalar Field"))


def range_bounds(first: Column, last: Column, total: Column, start: Column, stop: Column) -> Column:
    """struct<low, high>: coordinates at both ends (inclusive) of an index range on an even axis of ``total`` places."""
    at = lambda i: F.when(total <= 1, first).otherwise(first + i / F.greatest(total - 1, F.lit(1)) * (last - first))
    a, b = at(F.least(start, stop)), F.when(total <= 1, last).otherwise(at(F.greatest(start, stop)))
    return F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))


def ease(t: Column) -> Column:
    """Cubic ease from 0 to 1, slow at both ends."""
    u = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.when(u < 0.5, 4 * u * u * u).otherwise(1 - 4 * (1 - u) * (1 - u) * (1 - u))

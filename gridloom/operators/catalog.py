"""Metadata tables (variables, groups, catalogues) and residency tables (blocks, requests, windows)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.fmt import ancestors, group_path, leaf
from gridloom.functions.scale import slot_of


def contains(text: Column, query: str) -> Column:
    return F.coalesce(F.lower(text).contains(query.lower()), F.lit(False))


def search_variables(variables: DataFrame, query: str) -> DataFrame:
    """Variables whose name, long name or units hold the query, and all direct variables of a group whose own name does."""
    hit = contains(F.col("name"), query) | contains(F.col("long_name"), query) | contains(F.col("units"), query)
    return variables.where(hit | contains(leaf(group_path(F.col("name"))), query))


def group_counts(variables: DataFrame) -> DataFrame:
    """Variables at or below every group."""
    return variables.select(F.explode(ancestors(group_path(F.col("name")))).alias("grp")).groupBy("grp").agg(F.count("*").alias("n"))


def first_per_group(variables: DataFrame, order: str, most: int = 100) -> DataFrame:
    """The first ``most`` variables of each group, with the group's total."""
    named = variables.withColumn("grp", group_path(F.col("name")))
    totals = named.groupBy("grp").agg(F.count("*").alias("total"))
    ranked = named.withColumn("pos", F.row_number().over(Window.partitionBy("grp").orderBy(order))).where(F.col("pos") <= most)
    return ranked.join(totals, "grp")


def inherit(variables: DataFrame, groups: DataFrame, attribute: str) -> DataFrame:
    """``attribute`` of each variable: its own, else that of the nearest group above that has one (groups: grp, value)."""
    above = variables.select("name", attribute, F.posexplode(ancestors(group_path(F.col("name")))).alias("distance", "grp"))
    met = above.join(groups.where(F.col("value").isNotNull()), "grp", "left")
    return met.groupBy("name").agg(F.coalesce(F.first(attribute), F.min_by("value", F.when(F.col("value").isNotNull(), F.col("distance")))).alias(attribute))


def filter_catalog(entries: DataFrame, query: str, columns: list[str], category: tuple[str, str] | None = None) -> DataFrame:
    hit = F.lit(False)
    for c in columns:
        hit = hit | contains(F.col(c), query)
    return entries.where(hit if category is None else hit & (F.col(category[0]) == category[1]))


def variable_tree(variables: DataFrame) -> DataFrame:
    """The groups of a store (path, name, parent, depth) with the variables in each (direct), at or below it (total), and the place (from 0) among
    its siblings, which stand in the order in which variables (by ``pos``) first name them.  The root has an empty path and no parent.

    Empty parts of a path do not count."""
    clean = F.array_join(F.filter(F.split("name", "/"), lambda p: p != ""), "/")
    own = group_path(clean)
    named = variables.select(own.alias("_own"), "pos").groupBy("_own").agg(F.count("*").alias("_n"), F.min("pos").alias("_first"))
    below = named.select(F.explode(ancestors(F.col("_own"))).alias("path"), "_own", "_n", "_first")
    groups = below.groupBy("path").agg(F.sum(F.when(F.col("_own") == F.col("path"), F.col("_n")).otherwise(0)).alias("direct"), F.sum("_n").alias("total"), F.min("_first").alias("first"))
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    groups = groups.withColumns({"parent": F.when(F.col("path") != "", group_path(F.col("path"))), "name": leaf(F.col("path")), "depth": depth})
    return groups.withColumn("place", F.row_number().over(Window.partitionBy("parent").orderBy("first", "path")) - 1)


def cache_summary(blocks: DataFrame) -> DataFrame:
    """Blocks and bytes of each variable of each source, ordered by variable, then source."""
    return blocks.groupBy("source", "variable").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).orderBy("variable", "source")


def bytes_by(blocks: DataFrame, *keys: str) -> DataFrame:
    """Blocks and bytes by each key alone, in one pass: a row has a value under its own key and null under the others."""
    return blocks.groupingSets([[F.col(k)] for k in keys], *keys).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def lru_survivors(blocks: DataFrame, most: int, *keys: str, bins: int = 32) -> DataFrame:
    """Blocks that stay when the least recently used go until at most ``most`` bytes are left, within each cache.

    Accesses are cut into ``bins`` spans with about as many blocks each; totals of spans say where each span starts, spans that
    start beyond ``most`` go unsorted, and only the blocks of one span of one cache are sorted together.  Bytes are not negative."""
    edges = blocks.agg(F.percentile_approx("last_access", [k / bins for k in range(1, bins)], 10 * bins)).first()[0] or []
    edges = sorted(set(edges))
    placed = blocks.withColumn("_span", len(edges) - slot_of("last_access", edges))  # 0 is the latest
    sums = placed.groupBy(*keys, "_span").agg(F.sum("bytes").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0))).where(F.col("_start") <= most).drop("_sum")
    inside = Window.partitionBy(*keys, "_span").orderBy(F.desc("last_access"), F.desc("block")).rowsBetween(Window.unboundedPreceding, 0)
    held = placed.join(starts, [*keys, "_span"]).withColumn("held", F.col("_start") + F.sum("bytes").over(inside))
    return held.where(F.col("held") <= most).drop("_span", "_start")


def union_catalogs(catalogs: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Entries of several catalogues with the name of their own under ``catalog``; columns that one lacks are null."""
    named = [c.withColumn("catalog", F.lit(name)).select(*[x if x in c.columns else F.lit(None).alias(x) for x in columns], "catalog") for name, c in catalogs.items()]
    return reduce(DataFrame.unionByName, named)


def first_match(rows: DataFrame, keys: list[str], order: str, hit: Column, value: Column) -> DataFrame:
    """Per key ``value`` of the first row in ``order`` where ``hit`` holds; null where none does."""
    return rows.groupBy(*keys).agg(F.min_by(value, F.when(hit, F.col(order))).alias("first"))


def uncached(requests: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    return requests.join(blocks.select(*keys).distinct(), keys, "left_anti")


def covered(requests: DataFrame, blocks: DataFrame, keys: list[str], step: str = "step", chunk: int = 1) -> DataFrame:
    """Requests whose step lies inside a resident block (start, stop) with equal other selections.

    Blocks are listed under the chunk windows they touch, so the interval condition is tested within an equi-join."""
    listed = blocks.withColumn("_w", F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor((F.col("stop") - 1) / chunk))))
    on = requests.withColumn("_w", F.floor(F.col(step) / chunk))
    cond = [on[k] == listed[k] for k in keys] + [on["_w"] == listed["_w"], on[step] >= listed["start"], on[step] < listed["stop"]]
    return on.join(listed, cond, "left_semi").drop("_w")


def tumbling(t: Column, chunk: int, size: int) -> Column:
    """struct<start, stop> of the chunk-aligned window that holds step t."""
    start = F.floor(t / chunk) * chunk
    return F.struct(start.cast("long").alias("start"), F.least(start + chunk, F.lit(size)).cast("long").alias("stop"))


def lookahead(t: Column, chunk: int, size: int, ahead: int, loop: bool) -> Column:
    """Chunks to fetch after the one that holds step t: the next ``ahead``, going round when looping."""
    chunks, at = -(-size // chunk), F.floor(t / chunk).cast("long")
    following = F.transform(F.sequence(F.lit(1), F.lit(ahead)), lambda k: at + k)
    return F.transform(following, lambda c: F.pmod(c, F.lit(chunks))) if loop else F.filter(following, lambda c: c < chunks)

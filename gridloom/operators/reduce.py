"""Reductions that leave missing values out: bounds, projections along an axis, compositing, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scale import finite


def bounds(cells: DataFrame, *keys: str) -> DataFrame:
    """Finite minimum and maximum, (0, 1) where there is none."""
    v = finite(F.col("v"))
    return cells.groupBy(*keys).agg(F.coalesce(F.min(v), F.lit(0.0)).alias("lo"), F.coalesce(F.max(v), F.lit(1.0)).alias("hi"))


def running_bounds(steps: DataFrame, t: str, *keys: str) -> DataFrame:
    """Bounds over all steps so far; ``steps`` has one row per step, so the window is short."""
    w = Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumns({"run_lo": F.min("lo").over(w), "run_hi": F.max("hi").over(w)})


def project(cells: DataFrame, how: str, keys: list[str], low: float | None = None, high: float | None = None) -> DataFrame:
    """Maximum, minimum or mean along the other dimensions; ``low`` and ``high`` leave values outside them out."""
    v = finite(F.col("v"))
    if low is not None:
        v = F.when(v >= low, v)
    if high is not None:
        v = F.when(v <= high, v)
    return cells.groupBy(*keys).agg({"max": F.max, "min": F.min, "mean": F.avg}[how](v).alias("v"))


def first_hit(cells: DataFrame, along: str, keys: list[str], hit: Column) -> DataFrame:
    """First place along a ray where ``hit`` holds, and the value there."""
    return cells.where(hit).groupBy(*keys).agg(F.min(along).alias("at"), F.min_by("v", along).alias("v"))


def attenuated_max(cells: DataFrame, along: str, keys: list[str], unit: Column, factor: float, size: int) -> DataFrame:
    """Value with the largest product of value and exp(-factor * running sum of unit / size) along a ray.
    A ray is as long as the dimension, never as the data."""
    w = Window.partitionBy(*keys).orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
    weighed = cells.where(finite(F.col("v")).isNotNull()).withColumn("_w", F.col("v") * F.exp(-factor * F.sum(unit).over(w) / size))
    return weighed.groupBy(*keys).agg(F.max_by("v", F.struct(F.round("_w", 9), -F.col(along))).alias("v"))


def transmittance(cells: DataFrame, along: str, keys: list[str], alpha: Column) -> DataFrame:
    """Light that reaches each cell of a ray from the front, and the light it gives off."""
    w = Window.partitionBy(*keys).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    shaded = cells.withColumn("_a", alpha)
    through = F.exp(F.coalesce(F.sum(F.log1p(-F.col("_a"))).over(w), F.lit(0.0)))
    return shaded.withColumn("through", through).withColumn("light", F.col("through") * F.col("_a")).drop("_a")


def composite(cells: DataFrame, along: str, keys: list[str], colour: dict[str, Column], alpha: Column, slab: int, least: float = 1e-12) -> DataFrame:
    """Light of each ray by front-to-back compositing: ``colour``'s channels (weighed by alpha) and ``alpha`` of the whole ray.

    A ray is cut into slabs of ``slab`` places.  Each slab is reduced alone, cell by cell from the front, to its light and the part that it
    lets through, and takes no further cells once that is less than ``least``; slabs then merge in order by the operator "over", which is
    associative, so a long ray is not one task's work.  Missing cells (alpha null) let everything through."""
    names = list(colour)
    state = "struct<" + ",".join(f"c{k}:double" for k in range(len(names))) + ",t:double>"
    clear = F.struct(*[F.lit(0.0).alias(f"c{k}") for k in range(len(names))], F.lit(1.0).alias("t")).cast(state)
    samples = cells.select(*keys, F.floor(F.col(along) / slab).cast("long").alias("_slab"), F.struct(F.col(along).alias("_z"), alpha.alias("a"), *[c.alias(f"c{k}") for k, c in enumerate(colour.values())]).alias("_s")).where("_s.a IS NOT NULL")

    def over(acc: Column, lit: list[Column], through: Column) -> Column:
        return F.struct(*[(acc[f"c{k}"] + acc["t"] * c).alias(f"c{k}") for k, c in enumerate(lit)], (acc["t"] * through).alias("t"))

    def step(acc: Column, s: Column) -> Column:
        return F.when(acc["t"] < least, acc).otherwise(over(acc, [s["a"] * F.coalesce(s[f"c{k}"], F.lit(0.0)) for k in range(len(names))], 1 - s["a"]))

    slabs = samples.groupBy(*keys, "_slab").agg(F.array_sort(F.collect_list("_s")).alias("_s")).select(*keys, "_slab", F.aggregate("_s", clear, step).alias("light"))
    rays = slabs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_slab", "light"))).alias("_r"))
    light = F.aggregate("_r", clear, lambda acc, r: over(acc, [r["light"][f"c{k}"] for k in range(len(names))], r["light"]["t"]))
    return rays.select(*keys, light.alias("_l")).select(*keys, *[F.col(f"_l.c{k}").alias(n) for k, n in enumerate(names)], (1 - F.col("_l.t")).alias("alpha"))


def category_counts(cells: DataFrame) -> DataFrame:
    """Each value (rounded to 1e-5) and the number of its cells, over all cells; missing cells under null."""
    return cells.groupBy(F.round(finite(F.col("v")), 5).alias("v")).agg(F.count("*").alias("n"))


def categories(cells: DataFrame, most: int = 20) -> list[float]:
    """Distinct values (1e-5 apart) of all cells, ascending; empty unless there are 2 to ``most``."""
    # Of rounded values at least every other one is kept, so the limit only tells that there are more than ``most``.
    found = [r.v for r in category_counts(cells).where("v IS NOT NULL").select("v").orderBy("v").limit(10 * most).collect()]
    kept: list[float] = []
    for v in found:
        if not kept or v - kept[-1] > 1e-5:
            kept.append(v)
    return kept if 2 <= len(kept) <= most else []


def bins(low: float, high: float, n: int = 10) -> list[float]:
    """Centres of equal bins."""
    return [low + (k + 0.5) * (high - low) / n for k in range(n)]

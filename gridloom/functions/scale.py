"""Values to display scalars: scaling and its inverse, colour maps, clipping, surface heights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINEAR, LOG, SYMLOG, SQRT, EXP = range(5)

# Control colours of each map, evenly spaced from 0 to 1.
COLORMAPS = {
    "viridis": [(0.267, 0.004, 0.329), (0.231, 0.322, 0.545), (0.129, 0.569, 0.551), (0.369, 0.788, 0.384), (0.992, 0.906, 0.145)],
    "plasma": [(0.051, 0.031, 0.529), (0.416, 0.000, 0.659), (0.694, 0.165, 0.565), (0.882, 0.392, 0.384), (0.941, 0.976, 0.129)],
    "inferno": [(0.000, 0.000, 0.016), (0.341, 0.062, 0.429), (0.733, 0.216, 0.330), (0.976, 0.557, 0.035), (0.988, 1.000, 0.643)],
    "magma": [(0.000, 0.000, 0.016), (0.318, 0.071, 0.486), (0.714, 0.212, 0.475), (0.984, 0.533, 0.380), (0.988, 0.992, 0.749)],
    "turbo": [(0.190, 0.072, 0.232), (0.156, 0.447, 0.996), (0.134, 0.887, 0.525), (0.925, 0.875, 0.134), (0.900, 0.180, 0.090)],
    "coolwarm": [(0.230, 0.299, 0.754), (0.865, 0.865, 0.865), (0.706, 0.016, 0.150)],
    "cividis": [(0.000, 0.135, 0.304), (0.286, 0.337, 0.435), (0.506, 0.514, 0.463), (0.741, 0.702, 0.430), (0.996, 0.906, 0.145)],
}


def finite(v: Column) -> Column:
    """v where it is a finite number, else null."""
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def clamp(v: Column, low: float, high: float) -> Column:
    return F.when(v.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), v)))  # greatest and least pass nulls over


def scale(v: Column, low: float, high: float, kind: int = LINEAR, param: float = 0.0) -> Column:
    """Place of v between low and high on a colour axis, 0 to 1."""
    import math

    width = max(high - low, 1e-30)
    unit = clamp((v - low) / width, 0.0, 1.0)
    if kind == LOG and low >= -1e-15:
        start = max(high * 0.001, 1e-12) if low <= 1e-15 else low
        stop = max(high, start * 1.0001)
        span = max(math.log(stop) - math.log(start), 1e-6)
        placed = clamp((F.ln(F.greatest(v, F.lit(start))) - math.log(start)) / span, 0.0, 1.0)
        return F.when(v <= start, 0.0).otherwise(F.pow(placed, F.lit(param if param > 0 else 1.0)))
    if kind == SYMLOG:
        c, safe = (param if param > 0 else 1.0), max(abs(width), 1e-6)
        return clamp((F.ln(c + unit * safe) - math.log(c)) / (math.log(c + safe) - math.log(c)), 0.0, 1.0)
    if kind == SQRT:
        centred = 2.0 * unit - 1.0
        return clamp(0.5 + 0.5 * F.signum(centred) * F.sqrt(F.abs(centred)), 0.0, 1.0)
    if kind == EXP:
        k = param if param > 0 else 3.0
        return clamp((F.exp(unit * k) - 1.0) / (math.exp(k) - 1.0), 0.0, 1.0)
    return unit


def unscale(t: Column, low: float | Column, high: float | Column, kind: int = LINEAR, param: float = 0.0) -> Column:
    """The value at place t of a colour axis, whose bounds are numbers or columns."""
    import math

    t, low, high = clamp(t, 0.0, 1.0), *(b if isinstance(b, Column) else F.lit(float(b)) for b in (low, high))
    width = F.greatest(high - low, F.lit(1e-30))
    if kind == SYMLOG:
        c, safe = (param if param > 0 else 1.0), F.greatest(width, F.lit(1e-6))
        unit = c * (F.pow(1.0 + safe / c, t) - 1.0) / safe
    elif kind == SQRT:
        y = 2.0 * t - 1.0
        unit = 0.5 + 0.5 * F.signum(y) * y * y
    elif kind == EXP:
        k = param if param > 0 else 3.0
        unit = F.ln(1.0 + t * (math.exp(k) - 1.0)) / k
    else:
        unit = t
    value = low + clamp(unit, 0.0, 1.0) * width
    if kind == LOG:
        start = F.when(low <= 1e-15, F.greatest(high * 0.001, F.lit(1e-12))).otherwise(low)
        stop = F.greatest(high, start * 1.0001)
        value = F.when(low >= -1e-15, F.exp(F.ln(start) + F.pow(t, F.lit(1.0 / (param if param > 0 else 1.0))) * (F.ln(stop) - F.ln(start)))).otherwise(value)
    return value


def colormap(t: Column, name: str) -> Column:
    """struct<r,g,b> between the control colours; unknown names give viridis."""
    stops = COLORMAPS.get(name, COLORMAPS["viridis"])
    n = len(stops) - 1
    seg = F.least(F.floor(t * n), F.lit(n - 1))
    part = t * n - seg
    channels = []
    for k in range(3):
        ramp = F.array(*[F.lit(c[k]) for c in stops])
        a, b = F.element_at(ramp, (seg + 1).cast("int")), F.element_at(ramp, (seg + 2).cast("int"))
        channels.append((a + (b - a) * part).alias("rgb"[k]))
    return F.struct(*channels)


def colour_policy(v: Column, low: float, high: float, name: str, nan=(0.5, 0.5, 0.5), below=(0.0, 0.0, 1.0), above=(1.0, 0.0, 0.0), use_nan=True, use_below=True, use_above=True, categories: int = 0, kind: int = LINEAR) -> Column:
    """Colour with missing values, clipping and category bins: struct<r,g,b>, null where nothing is drawn."""
    fixed = lambda c: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(c, "rgb", strict=True)])
    t = scale(v, low, high, kind)
    if categories:
        t = (F.floor(clamp(t, 0.0, 0.999999) * categories) + 0.5) / categories
    missing = v.isNull() | F.isnan(v) | (F.abs(v) > 1e30)
    return (
        F.when(missing, fixed(nan) if use_nan else F.lit(None))
        .when(v < low, fixed(below) if use_below else colormap(F.lit(0.0), name))
        .when(v > high, fixed(above) if use_above else colormap(F.lit(1.0), name))
        .otherwise(colormap(t, name))
    )


def surface_height(v: Column, low: float, high: float, displacement: float = 1.0, steps: bool = False) -> Column:
    """Height of a surface over a plane; around zero where the range spans it."""
    factor = (0.6 if steps else 0.8) * displacement
    if low < 0 < high:
        placed = clamp(v / max(abs(low), abs(high)), -1.0, 1.0)
    else:
        placed = clamp((v - low) / max(high - low, 1e-6), 0.0, 1.0)
    return F.when(finite(v).isNull(), 0.0).otherwise(placed * factor)


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    """Three channels of 0 to 255 in one integer, red lowest; null if one is missing."""
    return r.cast("long").bitwiseOR(F.shiftleft(g.cast("long"), 8)).bitwiseOR(F.shiftleft(b.cast("long"), 16))


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> list[Column]:
    """Linear (1 - c)(1 - k) through the sRGB curve, as channels of 0 to 255."""

    def channel(x: Column) -> Column:
        light = (1 - x) * (1 - k)
        return F.round(255 * F.when(light <= 0.0031308, 12.92 * light).otherwise(1.055 * F.pow(light, F.lit(1 / 2.4)) - 0.055))

    return [channel(c), channel(m), channel(y)]


def slot_of(column: str, edges: list[float] | list[int], inclusive: bool = False) -> Column:
    """How many of the ascending numbers ``edges`` are below a column (or equal to it, when ``inclusive``): a tree of comparisons, as deep as the logarithm
    of their number, that is compiled.  Null for a null value."""
    sign, name = ">=" if inclusive else ">", f"`{column}`"
    literal = lambda e: f"{e!r}D" if isinstance(e, float) else f"{e}L"
    # As one text: a column made node by node is a call to the JVM for each.
    tree = lambda lo, hi: str(lo) if lo == hi else f"CASE WHEN {name} {sign} {literal(edges[(lo + hi) // 2])} THEN {tree((lo + hi) // 2 + 1, hi)} ELSE {tree(lo, (lo + hi) // 2)} END"
    return F.expr(f"CASE WHEN {name} IS NOT NULL THEN {tree(0, len(edges))} END")

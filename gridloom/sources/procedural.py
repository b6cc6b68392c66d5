"""Closed-form arrays: waves, a moving Gaussian packet, irregular axes, HEALPix fields.  All are column expressions, so a source of
any size is a range and a projection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.select import Index, Range, clamp_projection


def packet(t: Column, z: Column, y: Column, x: Column, shape: tuple[int, int, int, int], background: float = 5.0, amplitude: float = 50.0, swing: float = 30.0, sigma: float = 0.15, turns: float = 1.0) -> Column:
    """A Gaussian blob that circles in x and y while it rises in z over the steps."""
    nt, nz, ny, nx = shape
    part = lambda i, n, alone: i / (n - 1) if n > 1 else F.lit(alone)
    ft = part(t % nt, nt, 0.0)
    phi = 2 * math.pi * turns * ft
    away = lambda p, c: (p - c) * (p - c)
    distance = away(part(x, nx, 0.5), 0.5 + 0.3 * F.cos(phi)) + away(part(y, ny, 0.5), 0.5 + 0.3 * F.sin(phi)) + away(part(z, nz, 0.5), 0.2 + 0.6 * ft)
    return background + (amplitude + swing * F.sin(phi)) * F.exp(-distance / (2 * sigma * sigma))


def grid(spark: SparkSession, **sizes: int) -> DataFrame:
    """All index tuples of a dense array, the last dimension fastest; partitions are ranges of the flat index."""
    total = math.prod(sizes.values())
    out, below = {}, total
    for dim, n in sizes.items():
        below //= n
        out[dim] = F.pmod(F.floor(F.col("id") / below), F.lit(n)).cast("long")
    return spark.range(total).select(*[c.alias(d) for d, c in out.items()])


def block(spark: SparkSession, sizes: dict[str, int], **wanted: Range | Index) -> DataFrame:
    """The index tuples of a part of a dense array; dimensions that ``wanted`` does not name are whole, and ranges end where the array does.

    Only the part is made, however large the array is."""
    bounds = {dim: clamp_projection(wanted.get(dim, Range(0, n)), n).bounds() for dim, n in sizes.items()}
    part = grid(spark, **{dim: max(stop - start, 1) for dim, (start, stop) in bounds.items()})
    part = part.where(F.lit(all(stop > start for start, stop in bounds.values())))
    return part.select(*[(F.col(dim) + start).alias(dim) for dim, (start, _) in bounds.items()])


def packet_volume(spark: SparkSession, nt: int = 20, nz: int = 32, ny: int = 32, nx: int = 32) -> DataFrame:
    at = grid(spark, t=nt, z=nz, y=ny, x=nx)
    return at.withColumn("v", packet(F.col("t"), F.col("z"), F.col("y"), F.col("x"), (nt, nz, ny, nx)).cast("float"))


def wave(x: Column, y: Column, t: Column) -> Column:
    """Crossing waves on a 0 to 100 scale."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + 25 * F.sin(x * 0.1 + t * 0.2) + 25 * F.cos(y * 0.1 - t * 0.1)))


def clenshaw_curtis(n: int) -> list[float]:
    """Latitudes at the cosines of equal angles, north to south."""
    return [90.0 - 180.0 * k / (n - 1) for k in range(n)]


def gaussian_latitudes(n: int) -> list[float]:
    """Latitudes of the Gauss-Legendre nodes, north to south."""
    import numpy as np

    return np.degrees(np.arcsin(np.polynomial.legendre.leggauss(n)[0]))[::-1].tolist()


def stretched(n: int, low: float, high: float, power: float = 1.5) -> list[float]:
    """Points that lie closer together at the middle of the range."""
    mid, half = (low + high) / 2, (high - low) / 2
    return [mid + half * math.copysign(abs(u) ** power, u) for u in (2 * k / (n - 1) - 1 for k in range(n))]


def sphere_temperature(lon: Column, lat: Column, t: Column, layer: Column) -> Column:
    """A warm belt with four waves that travel with the steps; each layer is 6.5 colder.  Radians."""
    cos, sin = F.cos(lat), F.sin(lat)
    return 285.0 + 35.0 * cos - 15.0 * sin * sin + 18.0 * F.cos(4.0 * lon - t * 0.3) * cos * cos * F.sin(2.0 * lat) - layer * 6.5


def sphere_pressure(lon: Column, lat: Column, t: Column) -> Column:
    return 1013.25 + 25.0 * F.cos(4.0 * lon - t * 0.3) * F.cos(lat) * F.cos(lat) - 15.0 * F.sin(lat)

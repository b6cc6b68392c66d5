"""Numbers, sizes, units and CF times as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of time units and their milliseconds.
UNIT_MS = {
    **dict.fromkeys(("millisecond", "milliseconds", "msec", "msecs", "ms"), 1),
    **dict.fromkeys(("second", "seconds", "sec", "secs", "s"), 1000),
    **dict.fromkeys(("minute", "minutes", "min", "mins"), 60_000),
    **dict.fromkeys(("hour", "hours", "hr", "hrs", "h"), 3_600_000),
    **dict.fromkeys(("day", "days", "d"), 86_400_000),
}
# Bytes of an element by type label; others count 4.
TYPE_BYTES = {**dict.fromkeys(("float64", "int64", "uint64"), 8), **dict.fromkeys(("float32", "int32", "uint32"), 4), **dict.fromkeys(("int16", "uint16"), 2), **dict.fromkeys(("int8", "uint8", "bool"), 1)}


def lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def unit_ms(unit: Column) -> Column:
    return lookup(UNIT_MS, F.lower(F.trim(unit)))


def type_bytes(name: Column) -> Column:
    return F.coalesce(lookup(TYPE_BYTES, name), F.lit(4))


def fixed(v: Column, digits: int) -> Column:
    """v with so many decimals, no grouping."""
    return F.format_string(f"%.{digits}f", v.cast("double"))


def half_up(x: Column, digits: int) -> Column:
    """x >= 0 to so many decimals as C's ``round`` does it on the double: scaled, halves up, scaled back.  ``format_string`` and ``F.round`` round
    the shortest decimal text of x instead, which ends in 5 where the scaled double lies below a half."""
    y = x * float(10**digits)
    n = F.floor(y)
    return F.when(y - n >= 0.5, n + 1).otherwise(n) / float(10**digits)


def byte_size(n: Column, units: tuple[str, ...] = ("KB", "MB", "GB", "TB")) -> Column:
    """1536 as ``1.5 KB``; whole numbers without a decimal; what is over the last unit is in that."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, name in enumerate(units, 1):
        x = n / float(1024**k)
        text = F.concat(F.when(F.round((x - F.floor(x)) * 10) == 0, fixed(x, 0)).otherwise(fixed(half_up(x, 1), 1)), F.lit(f" {name}"))
        out = F.when(n >= 1024**k, text).otherwise(out)
    return out


def count_metric(n: Column) -> Column:
    """6480000 as ``6.48M``, 500000 as ``500K``."""
    m, k = n / 1e6, n / 1e3
    millions = F.concat(F.when(F.round((m - F.floor(m)) * 100) == 0, fixed(m, 0)).otherwise(fixed(half_up(m, 2), 2)), F.lit("M"))
    thousands = F.concat(F.when(F.round((k - F.floor(k)) * 10) == 0, fixed(k, 0)).otherwise(fixed(half_up(k, 1), 1)), F.lit("K"))
    return F.when(n >= 1_000_000, millions).when(n >= 1000, thousands).otherwise(n.cast("string"))


def tick(v: Column) -> Column:
    """Short text of an axis value: 0, 1.5e4, 12, 0.5 or 0.25."""
    a = F.abs(v)
    power = F.floor(F.log10(a))
    mantissa = F.round(v / F.pow(F.lit(10.0), power), 2)
    power = F.when(F.abs(mantissa) >= 10, power + 1).otherwise(power)
    mantissa = F.when(F.abs(mantissa) >= 10, mantissa / 10).otherwise(mantissa)
    short = F.regexp_replace(F.regexp_replace(fixed(mantissa, 2), "0+$", ""), r"\.$", "")
    part = lambda x: F.abs(x - F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)))
    return (
        F.when(a == 0, "0")
        .when((a < 0.001) | (a >= 10000), F.concat(short, F.lit("e"), power.cast("int").cast("string")))
        .when(part(v) < 1e-5, fixed(v, 0))
        .when(part(v * 10) < 1e-5, fixed(v, 1))
        .otherwise(fixed(v, 2))
    )


def with_unit(v: Column, unit: str) -> Column:
    return F.concat(F.when(v == F.floor(v), fixed(v, 0)).otherwise(fixed(v, 2)), F.lit(f" {unit}"))


def cf_time(v: Column, units: Column) -> Column:
    """A CF coordinate as text: ``hours since DATE`` as date and hour, durations in the coarsest exact unit, degrees, or two decimals."""
    low = F.lower(F.trim(units))
    since = low.contains(" since ")
    first = F.trim(F.substring_index(low, " since ", 1))
    start = F.coalesce(F.try_to_date(F.substring(F.trim(F.substring_index(low, " since ", -1)), 1, 10), "yyyy-MM-dd"), F.lit("1970-01-01").cast("date"))
    hours = F.round(v * F.coalesce(unit_ms(first), F.lit(1000)) / 3_600_000).cast("long")
    day = F.date_add(start, F.floor(hours / 24).cast("int"))
    stamp = F.concat(F.date_format(day, "MM-dd-yyyy"), F.lit(" "), F.lpad(F.pmod(hours, F.lit(24)).cast("string"), 2, "0"), F.lit(":00"))
    ms = v * unit_ms(low)
    kind = unit_ms(low)
    zero = F.when(kind.isin(1000, 3_600_000), "0 h").otherwise("0 ms")
    exact = lambda size: (ms >= size) & (ms % size == 0)
    span = (
        F.when(ms == 0, zero)
        .when(kind == 3_600_000, with_unit(v, "h"))
        .when(kind == 86_400_000, with_unit(v, "d"))
        .when(exact(3_600_000), with_unit(ms / 3_600_000, "h"))
        .when(exact(60_000), with_unit(ms / 60_000, "min"))
        .when(exact(1000), with_unit(ms / 1000, "s"))
        .when(kind == 60_000, with_unit(v, "min"))
        .when(kind == 1000, with_unit(v, "s"))
        .otherwise(with_unit(ms, "ms"))
    )
    return F.when(v.isNull(), F.lit(None)).when(since, stamp).when(kind.isNotNull(), span).when(low.contains("deg"), F.concat(fixed(v, 2), F.lit("°"))).otherwise(fixed(v, 2))


def axis_title(dim: Column) -> Column:
    """Dimension name with its unit by convention."""
    low = F.lower(dim)
    return F.when(low.contains("lon") | low.contains("lat"), F.concat(dim, F.lit(" (°)"))).when(low.contains("lev") | low.contains("pres"), F.concat(dim, F.lit(" (hPa)"))).otherwise(dim)


def leaf(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def group_path(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def ancestors(path: Column) -> Column:
    """The group itself and all groups above it, the root as an empty string, nearest first."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


#: A space that does not break a line.
HARD_SPACE = "\u00a0"


def coordinate_label(dim: Column, v: Column) -> Column:
    """Dimension and value with two decimals: east or west, north or south, metres or hectopascals by the dimension's name."""
    low = F.lower(dim)
    has = lambda *names: F.lit(False) if not names else F.regexp_like(low, F.lit("|".join(names)))
    degrees = lambda up, down: F.concat(fixed(F.abs(v), 2), F.when(v >= 0, up).otherwise(down))
    text = (
        F.when(has("lon"), degrees("°E", "°W"))
        .when(has("lat"), degrees("°N", "°S"))
        .when(has("depth", "height", "alt"), F.concat(fixed(v, 2), F.lit(HARD_SPACE + "m")))
        .when(has("lev", "pressure"), F.concat(fixed(v, 2), F.lit(HARD_SPACE + "hPa")))
        .otherwise(fixed(v, 2))
    )
    return F.concat(dim, F.lit(":" + HARD_SPACE), text)

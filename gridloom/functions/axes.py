"""Dates and labels of the steps of an axis, and the ticks of colour bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import fmt
from gridloom.functions.scale import LINEAR, LOG, clamp, unscale

# Where an axis starts and how many days a step takes when nothing says so.
START, STEP = "1979-01-01", 8
# What the address of a store says about its first day and about the days of a step; the first that fits counts.
HINTED_START = {"seasfire": "2001-01-01"}
HINTED_STEPS = [("16d", 16), ("8d|seasfire", 8), ("1d|daily", 1)]
# Dimensions and units of an axis of dates.
DATE_NAMES, DATE_UNITS = "time|date|year|month", "since|day|hour"

_DATE = r"^\s*(\d{1,9})-(\d{1,2})-(\d{1,2})(?:[-Tt\s]|$)"


def _has(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_like(F.lower(text), F.lit(pattern)), F.lit(False))


def iso_date(text: Column) -> Column:
    """The date that a text starts with; what follows after T, white space or another hyphen does not count.  Null where there is none."""
    part = lambda k: F.regexp_extract(text, _DATE, k)
    return F.when(part(1) != "", F.try_to_date(F.concat_ws("-", F.lpad(part(1), 4, "0"), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")), "yyyy-MM-dd"))


def step_days(resolution: Column, address: Column) -> Column:
    """Days of a step: by a resolution as 8D or 8 days, where there is none by what the store's address says, else ``STEP``."""
    clean = F.upper(F.trim(resolution))
    number = lambda text: F.when(F.regexp_like(text, F.lit(r"^\+?\d{1,9}$")), text.cast("int"))
    said = (
        F.when(clean.endswith("D"), F.coalesce(number(F.regexp_replace(clean, "D+$", "")), F.lit(STEP)))
        .when(F.regexp_like(clean, F.lit("DAYS?$")), F.coalesce(number(F.regexp_extract(clean, r"^(\S+)", 1)), F.lit(1)))
        .otherwise(STEP)
    )
    hinted = F.coalesce(*[F.when(_has(address, pattern), F.lit(days)) for pattern, days in HINTED_STEPS], F.lit(STEP))
    return F.when(resolution.isNotNull(), said).otherwise(hinted)


def reference(units: Column, start: Column, resolution: Column, address: Column) -> Column:
    """struct<day, days>: the date of step 0 and the days of a step.

    The date is that of ``start``, else the one after ``since`` in the units, else that of a known address, else ``START``.  Units of days
    make steps of one day where they give the date."""
    days, low = step_days(resolution, address), F.lower(units)
    since = F.when(low.contains(" since "), iso_date(F.regexp_extract(low, r"^.*? since (.*)$", 1)))
    own = F.when(F.regexp_like(low, F.lit("^(day|d )")), 1).otherwise(days)
    entry = lambda day, step: F.when(day.isNotNull(), F.struct(day.alias("day"), step.cast("int").alias("days")))
    hinted = [entry(F.when(_has(address, name), F.lit(day).cast("date")), days) for name, day in HINTED_START.items()]
    return F.coalesce(entry(iso_date(start), days), entry(since, own), *hinted, entry(F.lit(START).cast("date"), days))


def step_date(step: Column, at: Column) -> Column:
    """The date of a step, for ``at`` of :func:`reference`."""
    return F.date_add(at["day"], (step * at["days"]).cast("int"))


def date_step(day: Column, at: Column) -> Column:
    """The step that holds a date; negative before the start, null where steps take no days."""
    return F.when(at["days"] > 0, F.floor(F.datediff(day, at["day"]) / at["days"]).cast("long"))


def axis_label(step: Column, steps: Column, dim: Column, units: Column, start: Column, resolution: Column, address: Column) -> Column:
    """The date of a step of an axis of dates (by the names of dimension and units), else its number among all.

    Levels and degrees are not made up from the number of the step: values that an axis has are labelled by ``fmt.coordinate_label``."""
    dated = _has(F.coalesce(dim, F.lit("time")), DATE_NAMES) | _has(units, DATE_UNITS)
    number = F.concat(F.lit("Step "), (step + 1).cast("string"), F.lit(" / "), steps.cast("string"))
    return F.when(dated, F.date_format(step_date(step, reference(units, start, resolution, address)), "yyyy-MM-dd")).otherwise(number)


# --- Ticks -------------------------------------------------------------------------------------------------------------

#: Major ticks of a plain colour bar, and the parts that minor ones make between two of them.
MAJOR, PARTS = 5, 5
#: Decades that a bar has to span to be marked by decades, how far an end is from the next tick to get its own, and the slack of major ticks.
DECADES, NEAR, SLACK = 0.8, 0.02, 0.001


def _tick(at: Column, value: Column, major: Column) -> Column:
    return F.struct(at.alias("at"), value.alias("value"), major.alias("major"))


def _plain(low: Column, high: Column, kind: int, param: float) -> Column:
    last = (MAJOR - 1) * PARTS
    places = F.sequence(F.lit(0), F.lit(last))
    return F.transform(places, lambda k: _tick(k / float(last), unscale(k / float(last), low, high, kind, param), k % PARTS == 0))


def _decades(first: Column, last: Column, gamma: float) -> Column:
    """Powers of ten and their multiples between two positive bounds, and the bounds themselves where no tick is near."""
    a, b = F.log10(first), F.log10(last)
    span = F.greatest(b - a, F.lit(1e-6))
    at = lambda v: F.pow(clamp((F.log10(v) - a) / span, 0.0, 1.0), F.lit(gamma))
    marks = F.flatten(F.transform(F.sequence(F.floor(a) - 1, F.ceil(b)), lambda d: F.transform(F.sequence(F.lit(1), F.lit(9)), lambda m: F.struct(m.alias("m"), (m * F.pow(F.lit(10.0), d)).alias("v")))))
    inside = lambda x: F.when(x["m"] == 1, x["v"].between(first * (1 - SLACK), last * (1 + SLACK))).otherwise((x["v"] > first) & (x["v"] < last))
    ticks = F.transform(F.filter(marks, inside), lambda x: _tick(at(x["v"]), x["v"], x["m"] == 1))
    end = lambda place, value: F.when(F.exists(ticks, lambda t: F.abs(t["at"] - place) < NEAR), F.slice(ticks, 1, 0)).otherwise(F.array(_tick(F.lit(place), value, F.lit(True))))
    return F.concat(end(0.0, first), ticks, end(1.0, last))


def colorbar_ticks(bars: DataFrame, low: str, high: str, kind: int = LINEAR, param: float = 0.0) -> DataFrame:
    """Each bar (a row with its bounds) once for each of its ticks: at (place on the bar), value, major, and label (major ones only).

    Logarithmic bars over ``DECADES`` or more are marked by decades; others have five major ticks with four minor ones between each two.
    Bars without finite bounds have no ticks."""
    lo, hi = F.col(low).cast("double"), F.col(high).cast("double")
    known = bars.where(lo.between(-1.7e308, 1.7e308) & hi.between(-1.7e308, 1.7e308))
    ticks = _plain(lo, hi, kind, param)
    if kind == LOG:
        first = F.when(lo <= 1e-15, F.least(F.lit(1e-12), hi * 1e-6)).otherwise(lo)
        last = F.greatest(hi, first * 1.0001)
        wide = (first > 0) & (F.log10(last) - F.log10(first) >= DECADES)
        ticks = F.when(F.coalesce(wide, F.lit(False)), _decades(first, last, param if param > 0 else 1.0)).otherwise(ticks)
    marked = known.withColumn("_t", F.explode(ticks))
    return marked.select(*bars.columns, "_t.*").withColumn("label", F.when(F.col("major"), fmt.tick(F.col("value"))))

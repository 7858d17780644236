"""Column expressions of the record: rounding rules, names, distances, areas, colour ramps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The eleven western states, by the first two letters of a fire's id.
WEST = ("WA", "OR", "CA", "ID", "NV", "UT", "AZ", "MT", "WY", "CO", "NM")
M2_PER_ACRE = 4046.86
EARTH_MILES = 3958.7613
M_PER_DEGREE = 111320.0
#: Opacity of a fire by its age in years: (age, opacity) stops, linear between, flat beyond.
AGE_STOPS = ((0, 0.95), (1, 0.85), (3, 0.75), (8, 0.66), (20, 0.59), (40, 0.55))


def state(id_: Column) -> Column:
    return F.substring(id_, 1, 2)


def acres(m2: Column) -> Column:
    return m2 / F.lit(M2_PER_ACRE)


def whole_half_even(x: Column) -> Column:
    """Whole number, ties to even; Spark's round() takes ties away from zero."""
    return F.rint(x).cast("long")


def haversine_miles(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """Great-circle miles; the root is clamped at 1 so that antipodes don't leave arcsine's domain."""
    dlat, dlon = F.radians(lat1 - lat0) / 2, F.radians(lon1 - lon0) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * F.pow(F.sin(dlon), 2)
    return F.when(h.isNotNull(), 2 * EARTH_MILES * F.asin(F.least(F.lit(1.0), F.sqrt(h))))  # least() skips nulls


def degrees_to_metres(d: Column, lat: Column) -> Column:
    return d * M_PER_DEGREE * F.cos(F.radians(lat))


def slug(name: Column) -> Column:
    """File-safe section name."""
    s = F.replace(F.lower(name), F.lit("pct - "), F.lit(""))
    return F.replace(F.replace(s, F.lit(" section "), F.lit("-")), F.lit(" "), F.lit("-"))


def short_name(name: Column) -> Column:
    """Display name of a section."""
    return F.replace(F.replace(name, F.lit("PCT - "), F.lit("PCT — ")), F.lit(" Section "), F.lit(" "))


def age_opacity(age: Column, stops=AGE_STOPS) -> Column:
    """Piecewise-linear ramp over the stops."""
    out = F.lit(stops[-1][1])
    for (a0, o0), (a1, o1) in reversed(list(zip(stops, stops[1:]))):
        out = F.when(age < a1, F.lit(o0) + (age - a0) * F.lit((o1 - o0) / (a1 - a0))).otherwise(out)
    return F.when(age <= stops[0][0], F.lit(stops[0][1])).otherwise(out)


def count_of(m: Column, key: int) -> Column:
    """A string-keyed map's count, 0 where the key is missing."""
    return F.coalesce(F.element_at(m, str(key)), F.lit(0))


def round_coordinates(geom: Column, digits: int) -> Column:
    """A part -> ring -> point geometry with coordinates rounded half-even."""
    return F.transform(geom, lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: F.struct(F.bround(p["x"], digits).alias("x"), F.bround(p["y"], digits).alias("y")))))

"""Scalar helpers: clean numbers, keys, types, distances, colours, phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
BASE_CASE = "BASE CASE"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def clean(value: Column) -> Column:
    """A number, or null for what is missing, not a number, or not readable as one."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def clean_text(value: Column) -> Column:
    trimmed = F.trim(value)
    return F.when(~F.lower(trimmed).isin("", "nan", "none", "null"), trimmed)


def half_up(value: Column, digits: int) -> Column:
    """Decimal rounding, halves away from zero, of the number as printed."""
    return F.round(value.cast("string").cast("decimal(38,18)"), digits).cast("double")


def constraint_key(name: Column, contingency: Column) -> Column:
    return F.concat_ws("|", F.trim(name), F.trim(contingency))


def split_key(key: Column) -> tuple[Column, Column]:
    """Name, and contingency or null, of a constraint key."""
    cut = F.instr(key, "|")
    return F.substring_index(key, "|", 1), F.when(cut > 0, F.substring(key, cut + 1, F.length(key)))


def constraint_type(key: Column, n_rail: Column, peak_offrail: Column) -> Column:
    """gtc for the base case, else radial if one node is at the rail and the rest far off, else transmission."""
    _, contingency = split_key(key)
    return F.when(contingency == BASE_CASE, "gtc").when((n_rail >= 1) & (peak_offrail < 0.25), "radial").otherwise("transmission")


def point_type(sp: Column) -> Column:
    """hub or load_zone from a settlement point's name, else null."""
    return F.when(sp.startswith("HB_") & ~sp.endswith("AVG"), "hub").when(sp.startswith("LZ_"), "load_zone")


def voltage_class(kv: Column) -> Column:
    return F.when(kv.isNull(), "Unknown").otherwise(F.concat(F.bround(kv).cast("int").cast("string"), F.lit(" kV")))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def coordinates(code: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a ten-character code: two base-62 groups of micro-degrees."""

    def number(part: Column) -> Column:
        return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.position(F.substr(part, i, F.lit(1)), F.lit(BASE62)).cast("long") - 1), F.lit(0).cast("long"), lambda total, d: total * 62 + d)

    return number(F.substring(code, 1, 5)) / 1e6 - 90, number(F.substring(code, 6, 5)) / 1e6 - 180


def interpolate(value: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise linear through (value, position) control points, flat outside of them."""
    out = F.lit(points[-1][1])
    for (low, a), (high, b) in reversed(list(zip(points, points[1:], strict=False))):
        out = F.when(value < high, a + (value - low) * ((b - a) / (high - low))).otherwise(out)
    return F.when(value <= points[0][0], F.lit(points[0][1])).otherwise(out)


def congestion_position(value: Column, dead: float = 10.0, full: float = 100.0) -> Column:
    """-1 to 1 with a dead zone around 0."""
    size = F.least(F.greatest((F.abs(value) - dead) / (full - dead), F.lit(0.0)), F.lit(1.0))
    return F.signum(value) * size

"""Sums over windows of any length as differences of two prefixes.

Daily values are summed between the boundaries of all windows together, and added up along them once;
every window, of every length and refit step, is then one difference.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Windows = list[tuple[date, date]]


def grid(first: date, last: date, lengths: list[int], steps: list[int]) -> dict[tuple[int, int], Windows]:
    """For every length and step in days: the windows [end - length, end) that end on every step from
    ``first`` on, before ``last``."""
    ends = {s: [first + timedelta(days=d) for d in range(0, (last - first).days, s)] for s in steps}
    return {(n, s): [(e - timedelta(days=n), e) for e in ends[s]] for n in lengths for s in steps}


def prefixes(days: DataFrame, keys: list[str], boundaries: list[date], day: str = "day", value: str = "v") -> DataFrame:
    """(keys, prefix): the sums of the values before each boundary, in order."""
    passed = F.array(*(F.lit(b) for b in boundaries))
    part = F.size(F.filter(passed, lambda b: b <= F.col(day)))
    parts = days.groupBy(*keys, part.alias("part")).agg(F.sum(value).alias("v"))
    held = parts.where(F.col("part") < len(boundaries)).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("part", "v"))).alias("held"))
    kind = dict(parts.dtypes)["v"]
    step = lambda sums, i: F.concat(sums, F.array((F.coalesce(F.element_at(sums, -1), F.lit(0)) + F.coalesce(F.element_at("held", i), F.lit(0))).cast(kind)))
    first = F.array(F.coalesce(F.element_at("held", F.lit(0)), F.lit(0)).cast(kind))
    if len(boundaries) == 1:
        return held.select(*keys, first.alias("prefix"))
    return held.select(*keys, F.aggregate(F.sequence(F.lit(1), F.lit(len(boundaries) - 1)), first, step).alias("prefix"))


def window_sums(days: DataFrame, keys: list[str], windows: Windows, day: str = "day", value: str = "v") -> DataFrame:
    """(window_start, window_end, keys, v): the sum of every distinct window [start, end) in which the keys have rows."""
    bounds = sorted({d for w in windows for d in w})
    at = {d: i for i, d in enumerate(bounds)}
    own = F.array(*(F.struct(F.lit(a).alias("window_start"), F.lit(b).alias("window_end"), F.lit(at[a] + 1).alias("i"), F.lit(at[b] + 1).alias("j")) for a, b in sorted(set(windows))))
    # a row more for each part, so that a window whose values add up to nothing is told from one without rows
    counted = days.groupBy(*keys, day).agg(F.sum(value).alias("_v"), F.count(F.lit(1)).alias("_n"))
    sums, rows = (prefixes(counted.withColumnRenamed(c, "v"), keys, bounds, day) for c in ("_v", "_n"))
    both = sums.join(rows.withColumnRenamed("prefix", "rows"), keys)
    laid = both.select(*keys, "prefix", "rows", F.explode(own).alias("w"))
    between = lambda c: F.element_at(c, F.col("w.j")) - F.element_at(c, F.col("w.i"))
    return laid.where(between("rows") > 0).select("w.window_start", "w.window_end", *keys, between("prefix").alias("v"))


def admission_grid(days: DataFrame, first: date, last: date, lengths: list[int], steps: list[int], least: int) -> DataFrame:
    """(length, step, refit, admitted, hours): for every setting and refit, how many keys have at least ``least``
    binding hours (key, day, v) in the window before it, and the hours of those."""
    settings = [(n, s, end) for (n, s), windows in grid(first, last, lengths, steps).items() for _, end in windows]
    sums = window_sums(days, ["key"], [(end - timedelta(days=n), end) for n, _, end in settings])
    known = sums.where(F.col("v") >= least).groupBy("window_start", "window_end").agg(F.count(F.lit(1)).alias("admitted"), F.sum("v").alias("hours"))
    asked = days.sparkSession.createDataFrame(settings, "length int, step int, refit date")
    met = asked.join(known, (F.col("refit") == F.col("window_end")) & (F.date_sub("refit", F.col("length")) == F.col("window_start")), "left")
    return met.select("length", "step", "refit", F.coalesce("admitted", F.lit(0)).alias("admitted"), F.coalesce("hours", F.lit(0)).alias("hours"))

"""Scans of raw relations into long panels: lowest flags, vintages, clocks, completeness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from nodalis.functions import clock, fields


def lowest_flag(df: DataFrame, keys: list[str], value: str, flag: str = "dst_flag") -> DataFrame:
    """Of rows with the same keys, the value of the lowest flag."""
    return df.groupBy(*keys).agg(F.min_by(value, flag).alias(value))


def unique_or_raise(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with a check, made as its rows are read, that no key repeats."""
    count = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    checked = df.withColumn("_n", count)
    return checked.where(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate key "), F.concat_ws(", ", *(F.col(k).cast("string") for k in keys)))).cast("boolean")).otherwise(F.lit(True))).drop("_n")


def congestion(prices: DataFrame, lam: DataFrame) -> DataFrame:
    """(ts, sp, price, slam, c): price less system price, lowest flag on either side, hours both have."""
    spp = lowest_flag(prices, ["ts", "sp"], "price")
    return spp.join(lowest_flag(lam, ["ts"], "slam"), "ts").withColumn("c", F.col("price") - F.col("slam"))


def congestion_of(sums: DataFrame, money: str, volume: str) -> DataFrame:
    """``congestion`` from one pass: (ts, sp, dst_flag) sums of money and volume give node prices, and
    their totals over the nodes the system price, of the lowest flag each."""
    by_flag = sums.groupBy("ts", "dst_flag").agg(F.sum(money).cast("double").alias("m"), F.sum(volume).cast("double").alias("v"))
    lam = by_flag.groupBy("ts").agg(F.min_by(F.col("m") / F.col("v"), "dst_flag").alias("slam"))
    priced = sums.withColumn("price", F.col(money).cast("double") / F.col(volume).cast("double"))
    return lowest_flag(priced, ["ts", "sp"], "price").join(lam, "ts").withColumn("c", F.col("price") - F.col("slam"))


def realized_range(prices: DataFrame, lam: DataFrame, start: str, end: str) -> DataFrame:
    """(ts, sp, lmp, congestion) in cents for ts in [start, end]; congestion is null without a system price."""
    inside = F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    spp = lowest_flag(prices.where(inside), ["ts", "sp"], "price")
    joined = spp.join(lowest_flag(lam.where(inside), ["ts"], "slam"), "ts", "left")
    return joined.select("ts", "sp", fields.half_up(F.col("price"), 2).alias("lmp"), fields.half_up(F.col("price") - F.col("slam"), 2).alias("congestion"))


def panel_bounds(shadow: DataFrame, lam: DataFrame, prices: DataFrame) -> DataFrame:
    """First and last instant that shadow prices, or both price relations, have."""
    priced = lam.select("ts").intersect(prices.select("ts"))
    return shadow.select("ts").union(priced).distinct().agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_ts"))


def latest_vintage(df: DataFrame, keys: list[str], posted: str, cutoff: Column, tie: list[str] | None = None, count: str | None = None) -> DataFrame:
    """As-of: of the rows posted by ``cutoff``, for each key the newest; ``tie`` orders equal postings and
    ``count`` names a column for their number."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(posted, *(tie or []))
    newest = df.where(F.col(posted) <= cutoff).groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"), F.count(F.lit(1)).alias(count or "_n"))
    return newest.select(*keys, "_row.*", *([count] if count else []))


def as_of(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, values: list[str], bucket: str = "year", steps: int = 1 << 16) -> DataFrame:
    """Each left row with the values of the newest right row of its key at or before its time.

    Rows are sorted within a key's stretches of time (``bucket``, a unit of date_trunc; ``steps`` where time
    is a number), where the last value seen is carried forward; a stretch without one takes the last value of the stretches before
    it, of which a key has few. No pair of rows is ever formed, and no task holds a key's whole history.
    """
    marks = [F.lit(None).cast(dict(right.dtypes)[v]).alias(f"_{v}") for v in values]
    probe = left.select("*", F.col(left_ts).alias("_at"), F.lit(1).alias("_side"), *marks, F.lit(None).cast("boolean").alias("_hit"))
    build = right.select(*on, F.col(right_ts).alias("_at"), F.lit(0).alias("_side"), *(F.col(v).alias(f"_{v}") for v in values), F.lit(True).alias("_hit"))
    counted = isinstance(left.schema[left_ts].dataType, NumericType)
    stretch = (F.floor(F.col("_at") / steps) if counted else F.date_trunc(bucket, "_at")).alias("_stretch")
    value = F.struct(*(F.col(f"_{v}").alias(v) for v in values))
    kept = build.groupBy(*on, stretch).agg(F.max_by(value, "_at").alias("_value")).unionByName(probe.select(*on, stretch).distinct().withColumn("_value", F.lit(None)), allowMissingColumns=True)
    ends = kept.groupBy(*on, "_stretch").agg(F.first("_value", ignorenulls=True).alias("_value"))
    earlier = Window.partitionBy(*on).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*(F.col(k).alias(f"_on_{k}") for k in on), F.col("_stretch").alias("_from"), F.last("_value", ignorenulls=True).over(earlier).alias("_carried"))
    order = Window.partitionBy(*on, "_stretch").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = probe.unionByName(build, allowMissingColumns=True).withColumn("_stretch", stretch)
    last = F.last(F.when(F.col("_hit"), value), ignorenulls=True).over(order)
    inside = both.withColumn("_last", last).where("_side = 1")
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in on), F.col("_stretch").eqNullSafe(F.col("_from")))
    return inside.join(carried, same, "left").select(*left.columns, F.coalesce("_last", "_carried").alias("_last")).select(*left.columns, "_last.*")


def expected_hours(days: DataFrame, day: str = "day") -> DataFrame:
    """(day, ts): every hour that a delivery day has."""
    return days.select(day, F.explode(clock.hours_of(F.col(day))).alias("ts"))


def missing(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(present.select(*keys).distinct(), keys, "left_anti")


def completeness(days: DataFrame, relations: dict[str, DataFrame], day: str = "day") -> DataFrame:
    """For each day, one flag per relation that has any row on it, and whether all have."""
    out = reduce(lambda acc, x: acc.join(x[1].select(day).distinct().withColumn(f"has_{x[0]}", F.lit(True)), day, "left"), relations.items(), days)
    flags = [F.coalesce(F.col(f"has_{n}"), F.lit(False)) for n in relations]
    return out.select(day, *(f.alias(f"has_{n}") for f, n in zip(flags, relations, strict=True)), reduce(lambda a, b: a & b, flags).alias("complete"))


def interval_attach(rows: DataFrame, windows: DataFrame, day: str, start: str, length: int, on: list[str]) -> DataFrame:
    """Rows with the columns of the window [start, start + length days) that holds their day and key.

    Each window is laid out into its days, which turns the range condition into an equality."""
    laid = windows.withColumn("_day", F.explode(F.sequence(F.col(start), F.date_add(F.col(start), length - 1), F.expr("INTERVAL 1 DAY"))))
    return rows.join(laid.withColumnRenamed("_day", day), [day, *on], "left")


def lag_days(panel: DataFrame, value: str, days: int = 1, on: list[str] | None = None, ts: str = "ts", name: str = "lagged") -> DataFrame:
    """The value exactly ``days`` before, by a join on time: a gap gives null, not the row before the gap."""
    on = on or ["key"]
    earlier = panel.select(*on, (F.col(ts) + F.expr(f"INTERVAL {days} DAYS")).alias(ts), F.col(value).alias(name))
    return panel.join(earlier, [*on, ts], "left")


def ordinal_profile(df: DataFrame, ts: str, on: list[str]) -> DataFrame:
    """Rows numbered in time order within ``on``: days of 23 and 25 hours align by place."""
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(*on).orderBy(ts)))


def ordered_union(parts: list[DataFrame], key: str, limit: int | None = None) -> DataFrame:
    """Distinct keys of all parts in order of first appearance. A part has (key, place)."""
    labelled = reduce(DataFrame.unionByName, (p.select(key, F.lit(i).alias("part"), "place") for i, p in enumerate(parts)))
    first = labelled.groupBy(key).agg(F.min(F.struct("part", "place")).alias("at"))
    ranked = first.orderBy("at.part", "at.place", key)
    return (ranked.limit(limit) if limit is not None else ranked).select(key, "at.part", "at.place")

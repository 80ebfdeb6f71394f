"""Trailing history: binding features, percentiles, standouts, encodings, bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rows_before(n: int | None, by: list[str], order: str) -> object:
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding if n is None else -n, -1)


def daily(mu: DataFrame, deadband: float = 0.0, day: str = "day") -> DataFrame:
    """(key, day, binds, total): binding hours and their sum."""
    size = F.abs("mu")
    return mu.groupBy("key", day).agg(F.count_if(size > deadband).cast("long").alias("binds"), F.sum(F.when(size > deadband, size).otherwise(0.0)).alias("total"))


def binding_history(mu: DataFrame, deadband: float = 1.0, windows: tuple[int, ...] = (1, 7, 28), day: str = "day") -> DataFrame:
    """What each key did strictly before each day: binding hours over trailing *observed* days, life rate,
    mean size when binding, days since it last bound. Keys get a row on every observed day; the list of
    days is one row per day of the panel, so the grid is keys times days, as the features are."""
    days = mu.select(day).distinct().withColumn("ordinal", F.row_number().over(Window.orderBy(day)))
    grid = mu.select("key").distinct().crossJoin(F.broadcast(days))
    dense = grid.join(daily(mu, deadband, day), ["key", day], "left").fillna(0, ["binds"]).fillna(0.0, ["total"])
    longest = _rows_before(max(windows), ["key"], day)
    ever = _rows_before(None, ["key"], day)
    sums = [F.coalesce(F.sum("binds").over(_rows_before(n, ["key"], day)), F.lit(0)).alias(f"binds_{n}d") for n in windows]
    bound = F.sum("binds").over(longest)
    last = F.last(F.when(F.col("binds") > 0, F.col("ordinal")), ignorenulls=True).over(ever)
    return dense.select(
        "key", day, *sums,
        (F.coalesce(F.sum("binds").over(ever), F.lit(0)) / F.nullif(24 * (F.col("ordinal") - 1), F.lit(0))).alias("life_rate"),
        (F.sum("total").over(longest) / F.nullif(bound, F.lit(0))).alias(f"mean_mu_{max(windows)}d"),
        (F.col("ordinal") - last).alias("days_since"),
    )


def percentiles(rows: DataFrame, by: list[str], value: str, points: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9), nonzero: bool = False, least: int = 1) -> DataFrame:
    """Interpolated percentiles of each group; null where fewer than ``least`` values count."""
    kept = F.when((F.col(value) != 0) | F.lit(not nonzero), F.col(value))
    out = rows.groupBy(*by).agg(F.percentile(kept, list(points)).alias("p"), F.count(kept).alias("n"))
    return out.select(*by, "n", *(F.when(F.col("n") >= least, F.col("p")[i]).alias(f"p{round(100 * q):02d}") for i, q in enumerate(points)))


def zero_filled(rows: DataFrame, keys: DataFrame, days: DataFrame, value: str, day: str = "day") -> DataFrame:
    """One row for each key and day, 0 where there was none. ``days`` is a bounded calendar."""
    return keys.crossJoin(F.broadcast(days)).join(rows, [*keys.columns, day], "left").fillna(0.0, [value])


def conservative_rank(value: Column, prior: Column) -> Column:
    """1 + the number of prior values at or above ``value``."""
    return F.size(F.filter(prior, lambda x: x >= value)) + 1


def trailing_percentile(value: Column, prior: Column) -> Column:
    """100 times the share of prior values and today's at or below today's, nulls left out."""
    known = F.filter(F.concat(prior, F.array(value)), lambda x: x.isNotNull())
    return 100 * F.size(F.filter(known, lambda x: x <= value)) / F.nullif(F.size(known), F.lit(0))


def times(value: str, base: str) -> Column:
    """``value`` over ``base`` as IEEE doubles: over zero infinite, or NaN, which is above any number."""
    v, b = F.col(value), F.col(base)
    return F.when(b != 0, v / b).when(b == 0, F.when(v > 0, float("inf")).when(v < 0, float("-inf")).when(v == 0, float("nan")))


def elevated(today: DataFrame, history: DataFrame, ratio: float = 1.5, least: int = 10, k: int = 20, nonzero: bool = True) -> DataFrame:
    """Keys whose value is at least ``ratio`` times the median of their own nonzero history. Without ``nonzero``
    days of 0 are history too, and a median of 0 is passed by any value but a negative one."""
    own = percentiles(history, ["key"], "v", (0.5,), nonzero=nonzero, least=least)
    joined = today.join(own, "key").where((F.col("p50") > 0) | F.lit(not nonzero)).withColumn("ratio", times("v", "p50"))
    return joined.where(F.col("ratio") >= ratio).orderBy(F.desc("ratio"), "key").limit(k)


def chronic_under_called(today: DataFrame, history: DataFrame, days: int, below: float = 0.25) -> DataFrame:
    """Keys that bound on at least ``days`` days but are called at no more than ``below`` of their median."""
    own = history.where("v <> 0").groupBy("key").agg(F.count_distinct("day").alias("bound_days"), F.percentile("v", 0.5).alias("median")).where(F.col("bound_days") >= days)
    return own.join(today, "key", "left").withColumn("v", F.coalesce("v", F.lit(0.0))).where(F.col("v") <= below * F.col("median"))


def surprises(today: DataFrame, history: DataFrame, ratio: float = 1.25, least: int = 10, nonzero: bool = True) -> DataFrame:
    """Keys whose value is at least ``ratio`` times the 90th percentile of their nonzero history. Without
    ``nonzero`` days of 0 are history too, and the sign of the value counts."""
    own = percentiles(history, ["key"], "v", (0.9,), nonzero=nonzero, least=least)
    size = F.abs("v") / F.nullif("p90", F.lit(0.0)) if nonzero else times("v", "p90")
    return today.join(own, "key").withColumn("ratio", size).where(F.col("ratio") >= ratio)


def climatology(mu: DataFrame, hours: DataFrame) -> DataFrame:
    """(key, hour, p_bind, mean_mu, mu): chance of binding at an hour of the day times the size when bound.
    ``hours`` (ts) are all hours of the fit window; absent shadow prices are 0."""
    per_hour = hours.groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    bound = mu.where("mu > 0").groupBy("key", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("k"))
    size = mu.where("mu > 0").groupBy("key").agg(F.avg("mu").alias("mean_mu"))
    return bound.join(F.broadcast(per_hour), "hour").join(size, "key").select("key", "hour", (F.col("k") / F.col("n")).alias("p_bind"), "mean_mu", (F.col("k") / F.col("n") * F.col("mean_mu")).alias("mu"))


def target_encoding(rows: DataFrame, key: str, target: str, strength: float = 50.0) -> DataFrame:
    """(key, n, encoded): a key's mean target drawn towards the pooled one; use it on training rows only."""
    pooled = rows.agg(F.avg(target).alias("pooled"))
    per_key = rows.groupBy(key).agg(F.count(target).alias("n"), F.sum(target).alias("k"))
    return per_key.crossJoin(F.broadcast(pooled)).select(key, "n", ((F.col("k") + strength * F.col("pooled")) / (F.col("n") + strength)).alias("encoded"))


def apply_encoding(rows: DataFrame, encoded: DataFrame, key: str, pooled: float) -> DataFrame:
    return rows.join(encoded.select(key, "encoded"), key, "left").withColumn("encoded", F.coalesce("encoded", F.lit(pooled)))


def quantile_edges(rows: DataFrame, value: str, n: int) -> list[float]:
    """Inner edges of n bins, from the fit rows; equal edges fall together."""
    found = rows.agg(F.percentile(value, [i / n for i in range(1, n)]).alias("e")).first()["e"]
    return sorted(set(found or []))


def bucket(value: Column, edges: list[float]) -> Column:
    """The bin of a value, left-closed; -1 for null."""
    at = sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return F.when(value.isNull(), -1).otherwise(at)


def responses(mu: DataFrame, weather: DataFrame, names: list[str], least: int = 672) -> DataFrame:
    """(key, name, r): correlation of a constraint with each covariate over the hours that have both; an
    hour without a shadow price counts as 0. Sums over binding rows and over hours give it without a
    dense panel."""
    long = weather.select("ts", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("name", "x")).where("x IS NOT NULL")
    base = long.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") ** 2).alias("sxx"))
    own = mu.join(long, "ts").groupBy("key", "name").agg(F.sum("mu").alias("sm"), F.sum(F.col("mu") ** 2).alias("smm"), F.sum(F.col("mu") * F.col("x")).alias("smx"))
    n = F.col("n")
    vx, vm = F.col("sxx") / n - (F.col("sx") / n) ** 2, F.col("smm") / n - (F.col("sm") / n) ** 2
    r = (F.col("smx") / n - F.col("sx") / n * F.col("sm") / n) / F.sqrt(vx * vm)
    return own.join(F.broadcast(base), "name").where(n >= least).select("key", "name", F.when((vx > 1e-12) & (vm > 1e-12), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))

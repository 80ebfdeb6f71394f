"""Scoreboards and cascades: served-first history, fallbacks, gradeable days, splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_available(parts: list[DataFrame], by: list[str]) -> DataFrame:
    """Rows of the first part that has any for a group; adds ``part``."""
    labelled = reduce(DataFrame.unionByName, (p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)))
    best = F.min("part").over(Window.partitionBy(*by))
    return labelled.withColumn("_best", best).where("part = _best").drop("_best")


def served_first(weekly: DataFrame, daily: DataFrame, series: list[str]) -> DataFrame:
    """Daily rows, and the weekly rows of those weeks that no daily row of the series lies in."""
    served = daily.select(*series, F.to_date(F.date_trunc("week", "day")).alias("week")).distinct()
    rest = weekly.join(served, [*series, "week"], "left_anti")
    return daily.select(*series, F.col("day"), "value", F.lit("daily").alias("grain")).unionByName(rest.select(*series, F.col("week").alias("day"), "value", F.lit("weekly").alias("grain")))


def gradeable(served: DataFrame, graded: DataFrame, complete: DataFrame, day: str = "day") -> DataFrame:
    """Newest served day that is not graded and whose settled hours are all there."""
    return served.select(day).distinct().join(graded, day, "left_anti").join(complete, day, "left_semi").agg(F.max(day).alias(day))


def neighbours(days: DataFrame, day: Column, column: str = "day") -> DataFrame:
    """Nearest day before and after."""
    return days.agg(F.max(F.when(F.col(column) < day, F.col(column))).alias("previous"), F.min(F.when(F.col(column) > day, F.col(column))).alias("following"))


def splits(rows: DataFrame, cutover: str, day: str = "day") -> DataFrame:
    """Every row under ``all`` and under ``pre`` or ``post`` the cut-over. The slices overlap, so this is no
    grouping set; rows are doubled before a partial aggregation."""
    side = F.when(F.col(day) < F.lit(cutover).cast("date"), "pre").otherwise("post")
    return rows.withColumn("split", F.explode(F.array(F.lit("all"), side)))


def beats(metrics: list[str], model: str, other: str) -> Column:
    """Whether the model is strictly better on every metric."""
    return reduce(lambda a, b: a & b, (F.col(f"{model}_{m}") > F.col(f"{other}_{m}") for m in metrics))


def priority_lookup(rows: DataFrame, routes: list[tuple[str, DataFrame, str]], result: str = "sp") -> DataFrame:
    """Each row's first hit among (label, table (key, value), column) routes, with the route's label.

    The tables are joined one after another; Spark broadcasts those that are small by their own size."""
    out = rows
    for label, lookup, column in routes:
        out = out.join(lookup.select(F.col("key").alias(column), F.col("value").alias(f"_{label}")), column, "left")
    found = [F.when(F.col(f"_{label}").isNotNull(), F.struct(F.col(f"_{label}").alias(result), F.lit(label).alias("method"))) for label, _, _ in routes]
    return out.withColumn("_hit", F.coalesce(*found)).select(*rows.columns, f"_hit.{result}", F.coalesce("_hit.method", F.lit("none")).alias("method"))


def unique_only(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of the keys that have one value."""
    return pairs.groupBy(F.col(key).alias("key")).agg(F.count_distinct(value).alias("n"), F.min(value).alias("value")).where("n = 1").select("key", "value")
